"""One query for every contact rule, on synthetic typed atoms, rings and groups, with its SQL.

The embeddings are atoms in a box of some thirty Angstrom; elements, residues, type bits, hybridisation and bonded
neighbours follow from their number, in Spark and in SQL alike. So each rule meets every case, whatever the typing of a
real structure would give.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.operators import contacts, ligands, topology
from helixframe.operators.sasa import PROBE, sasa
from helixframe.operators.sasa import VDW as AREA_RADII
from helixframe.sources.adapters import table

SCALE = 40
ELEMENTS = ("N", "O", "C", "S", "F", "CL", "H", "O", "N", "C", "ZN", "BR")
RESNAMES = ("ALA", "CYS", "HIS", "ARG", "HOH", "HEM", "DA", "LIG", "MET", "GLU")
POLYMER = ("ALA", "CYS", "HIS", "ARG", "DA", "MET", "GLU")
NEAR = ("C", "H", "N", "H", "S")
STEPS = (1.0, -0.7, 0.3, -1.1, 0.5)
SPOTS = 48


def _pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _neighbour(n: Column, k: int) -> Column:
    number = n + (1 if k == 2 else 100_000 * (k + 1))
    at = [(F.col(c) + _pick(STEPS, (n + (i + 1) * k) % 5)).alias(c) for i, c in enumerate("xyz")]
    return F.struct(number.alias("atom_id"), _pick(NEAR, (n + k) % 5).alias("element"), *at)


def typed_atoms(spark, d):
    n = F.col("vec_id")
    at = table(spark, d, "embeddings").select("vec_id", *[(F.col("embedding")[i].cast("double") * SCALE).alias(c) for i, c in enumerate("xyz")], F.col("label").cast("string").alias("chain"))
    return at.select(
        n.alias("atom_id"), "x", "y", "z", "chain", F.floor(n / 8).cast("long").alias("resid"), _pick(RESNAMES, F.floor(n / 5) % 10).alias("resname"), _pick(ELEMENTS, n % 12).alias("el"), F.lit("").alias("altloc"),
        (F.floor((n * 40503 + 12345) * 69069 % 2147483648 / 256) % 65536).cast("int").alias("atom_type"), (n % 3 + 1).cast("int").alias("hyb"),
        F.when(n % 4 > 0, F.slice(F.array(*[_neighbour(n, k) for k in range(3)]), F.lit(1), (n % 4).cast("int"))).alias("nbrs"), F.when(n % 2 == 0, _neighbour(n, 3)).alias("second"),
    )


def rings(spark, d):
    n, at = F.col("atom_id"), F.struct("x", "y", "z").alias("center")
    normal = F.struct((n % 5 - 2).cast("double").alias("x"), (n % 7 - 3).cast("double").alias("y"), (n % 3 + 1).cast("double").alias("z")).alias("normal")
    return typed_atoms(spark, d).where("atom_id % 3 = 0").select(n.alias("ring_id"), "chain", "resid", "resname", at, normal, F.array("atom_id").alias("atom_ids"), "x", "y", "z")


def groups(spark, d):
    points = F.array(F.struct("x", "y", "z"), F.struct((F.col("x") + 1.5).alias("x"), "y", "z"))
    kind = F.when(F.col("atom_id") % 4 == 0, "positive").otherwise("negative")
    found = typed_atoms(spark, d).where("atom_id % 4 in (0, 3)")
    return found.select(F.col("atom_id").alias("group_id"), "chain", "resid", "resname", kind.alias("kind"), points.alias("points"), F.array("atom_id").alias("atom_ids"), F.when(kind == "positive", F.array(F.col("atom_id") + 3)).alias("first_bonds"), "x", "y", "z")


def surface(spark, d):
    """Areas of the synthetic atoms with SPOTS points an atom."""
    atoms = typed_atoms(spark, d).select(F.lit(0).alias("model_id"), "atom_id", F.col("el").alias("element"), "x", "y", "z")
    return sasa(atoms, points=SPOTS, decimals=None).select("atom_id", F.round("area", 2).alias("area"))


def angles(spark, d):
    """Angles of the synthetic atoms at the ring with the number before theirs; numbers without a ring give 0."""
    n = F.col("atom_id")
    asked = typed_atoms(spark, d).where("atom_id > 0").select((n - 1).alias("ring_id"), n.alias("point"), "x", "y", "z")
    return ligands.ring_angles(rings(spark, d), asked, []).select("point", "ring_id", F.round("angle", 5).alias("angle"))


def _rounded(df):
    return df.select("lhs", "rhs", "type", F.round("distance_sq", 6).alias("d2"))


# The same tables in SQL.


def _sql_pick(values: tuple, index: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({index} + 1)::INT]"


def _sql_neighbour(k: int) -> str:
    number = "n + 1" if k == 2 else f"n + {100_000 * (k + 1)}"
    at = ", ".join(f"'{c}': {c} + {_sql_pick(STEPS, f'(n + {(i + 1) * k}) % 5')}::DOUBLE" for i, c in enumerate("xyz"))
    return f"{{'id': {number}, 'e': {_sql_pick(NEAR, f'(n + {k}) % 5')}, {at}}}"


_VDW = "CASE el " + " ".join(f"WHEN '{e}' THEN {r}" for e, r in topology.VDW.items() if e in ELEMENTS) + " ELSE 1.7 END::DOUBLE"
ATOMS = f"""pt AS (SELECT vec_id AS n, embedding[1]::DOUBLE * {SCALE} AS x, embedding[2]::DOUBLE * {SCALE} AS y, embedding[3]::DOUBLE * {SCALE} AS z, label::VARCHAR AS chain, vec_id // 8 AS resid,
  {_sql_pick(RESNAMES, "(vec_id // 5) % 10")} AS resname, {_sql_pick(ELEMENTS, "vec_id % 12")} AS el FROM embeddings),
ato AS (SELECT *, (((n * 40503 + 12345) * 69069 % 2147483648) // 256) % 65536 AS t, n % 3 + 1 AS hyb, CASE WHEN n % 4 > 0 THEN list_slice([{", ".join(_sql_neighbour(k) for k in range(3))}], 1, n % 4) END AS nb,
  CASE WHEN n % 2 = 0 THEN {_sql_neighbour(3)} END AS sec, {_VDW} AS vdw, resname IN {POLYMER} AS polymer, resname = 'HOH' AS water FROM pt)"""
RINGS = "rng AS (SELECT n, chain, resid, resname, x, y, z, {'x': (n % 5 - 2)::DOUBLE, 'y': (n % 7 - 3)::DOUBLE, 'z': (n % 3 + 1)::DOUBLE} AS nrm FROM ato WHERE n % 3 = 0)"
D2 = "((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"


def _minus(p: str, q: str) -> tuple[str, str, str]:
    return tuple(f"({p}.{c} - {q}.{c})" for c in "xyz")


def _dot(u: tuple, v: tuple) -> str:
    return "(" + " + ".join(f"{a} * {b}" for a, b in zip(u, v, strict=True)) + ")"


def _cross(u: tuple, v: tuple) -> tuple:
    return tuple(f"({u[i]} * {v[j]} - {u[j]} * {v[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))


def _angle(u: tuple, v: tuple) -> str:
    size = f"sqrt({_dot(u, u)} * {_dot(v, v)})"  # two vectors of which one has no length have no angle
    return f"CASE WHEN {size} > 0 THEN degrees(acos(greatest(-1.0, least(1.0, {_dot(u, v)} / {size})))) END"


def _acute(angle: str) -> str:
    return f"least({angle}, 180.0 - {angle})"


def _distance(p: str, q: str) -> str:
    d = _minus(p, q)
    return _dot(d, d)


def _type(side: str, *names: str) -> str:
    return f"({side}.t & {sum(topology.TYPES[n] for n in names)}) <> 0"


SAME = "(a.resid = b.resid AND a.resname = b.resname AND a.chain = b.chain)"
OWN = "(a.chain = b.chain AND a.polymer AND b.polymer AND a.resid = b.resid AND a.resname = b.resname)"


def _close(k: int) -> str:
    return f"(a.chain = b.chain AND abs(a.resid - b.resid) <= {k})"


HEAVY = "({0}.el NOT IN ('H', 'D'))"
NO_HYDROGEN = f"{HEAVY.format('a')} AND {HEAVY.format('b')}"
HYDROGENS = "list_filter(coalesce(a.nb, []), lambda h: h.e IN ('H', 'D'))"


def _some(items: str, test: str) -> str:
    """test is over an item i."""
    return f"(len(list_filter({items}, lambda i: coalesce({test}, false))) > 0)"


def _pairs_sql(kind: str, test: str, symmetric: bool = False) -> str:
    order = "a.n < b.n" if symmetric else "a.n <> b.n"
    return f"WITH {ATOMS} SELECT DISTINCT least(a.n, b.n) AS lhs, greatest(a.n, b.n) AS rhs, '{kind}' AS type, round({D2}, 6) AS d2 FROM ato a JOIN ato b ON {order} WHERE {test}"


def _flat_sql(side: str, nbrs: str, point: str, most: float) -> str:
    """side is an atom, nbrs a list, point a struct or an atom."""
    first = _minus(f"{nbrs}[1]", side)
    normal = [_cross(first, _minus(f"{second}", side)) for second in (f"{nbrs}[2]", f"{side}.sec")]
    t = _minus(point, side)
    off = [f"degrees(abs(atan2({_dot(n, t)}, sqrt({_dot(_cross(n, t), _cross(n, t))}))))" for n in normal]
    return f"(NOT ({side}.hyb = 2 AND len({nbrs}) >= 1) OR coalesce(CASE WHEN len({nbrs}) >= 2 THEN {off[0]} ELSE {off[1]} END <= {most}, true))"


def _hbond_sql(kind: str, donor: str, sulfur: float, least: float) -> str:
    """Donor a, acceptor b; the neighbours without each other are d_n, a_n, the donor's hydrogens d_h, the place that the acceptor sees p."""
    ideal = lambda s: f"(CASE {s}.hyb WHEN 1 THEN 180.0 WHEN 2 THEN 120.0 ELSE 109.4721 END)"
    heavy = lambda s, o, more="true": f"list_filter(coalesce({s}.nb, []), lambda i: i.e NOT IN ('H', 'D') AND i.id <> {o}.n AND {more})"
    cluster = "(NOT (a.el = 'S' AND NOT a.polymer) OR i.e IN ('C', 'N', 'O', 'S', 'P'))"
    reach = f"CASE WHEN a.el = 'S' OR b.el = 'S' THEN {sulfur * sulfur} ELSE 12.25 END"
    nearest = f"list_sort(list_transform(d_h, lambda i: {{'d2': {_distance('i', 'b')}, 'x': i.x, 'y': i.y, 'z': i.z}}))[1]"
    return f"""WITH {ATOMS}, met AS (SELECT a, b, {heavy("a", "b", cluster)} AS d_n, {heavy("b", "a")} AS a_n, {HYDROGENS} AS d_h FROM ato a JOIN ato b ON a.n <> b.n
  WHERE {_type("a", donor)} AND {_type("b", "HbondAcceptor")} AND {D2} >= {least} AND {D2} <= {reach} AND {D2} <= 4.1 * 4.1 AND NOT {OWN} AND NOT (a.water AND b.water)),
seen AS (SELECT *, CASE WHEN len(d_h) > 0 THEN {nearest} ELSE {{'d2': {_distance("a", "b")}, 'x': a.x, 'y': a.y, 'z': a.z}} END AS p FROM met)
SELECT DISTINCT least(a.n, b.n) AS lhs, greatest(a.n, b.n) AS rhs, '{kind}' AS type, round({D2}, 6) AS d2 FROM seen
WHERE NOT {_some("d_n", f"abs({_angle(_minus('b', 'a'), _minus('i', 'a'))} - {ideal('a')}) > 45.0")}
  AND (len(d_h) = 0 OR {_some("d_h", f"{_angle(_minus('b', 'a'), _minus('i', 'a'))} < 45.0")}) AND {_flat_sql("a", "d_n", "b", 45.0)}
  AND NOT {_some("a_n", f"{_angle(_minus('p', 'b'), _minus('i', 'b'))} < {ideal('b')} - 45.0")} AND {_flat_sql("b", "a_n", "p", 90.0)}"""


def _halogen_sql() -> str:
    heavy = lambda s, o: f"list_filter(coalesce({s}.nb, []), lambda i: i.e NOT IN ('H', 'D') AND i.id <> {o}.n)"
    return f"""WITH {ATOMS}, met AS (SELECT a, b, {heavy("a", "b")} AS d_n, {heavy("b", "a")} AS a_n FROM ato a JOIN ato b ON a.n <> b.n WHERE {_type("a", "XbondDonor")} AND {_type("b", "XBondAcceptor")} AND {D2} <= 16.0 AND a.nb IS NOT NULL AND b.nb IS NOT NULL)
SELECT DISTINCT least(a.n, b.n) AS lhs, greatest(a.n, b.n) AS rhs, 'Halogen' AS type, round({D2}, 6) AS d2 FROM met WHERE len(d_n) = 1 AND len(a_n) > 0
  AND {_some("d_n", f"180.0 - {_angle(_minus('b', 'a'), _minus('i', 'a'))} <= 30.0")} AND NOT {_some("a_n", f"{_angle(_minus('a', 'b'), _minus('i', 'b'))} < 90.0")}"""


def _bonded(a: str, b: str) -> str:
    return _some(f"coalesce({a}.nb, [])", f"i.id = {b}.n")


_NEAR_H = _some(HYDROGENS, f"{_distance('i', 'b')} <= (b.vdw + 1.2 + 0.1) * (b.vdw + 1.2 + 0.1)")


def _bent(least: float) -> str:
    return _some(HYDROGENS, f"{_angle(_minus('a', 'i'), _minus('b', 'i'))} >= degrees({least})")


_SULFUR = lambda s: f"({s}.resname = 'CYS' AND {_some(f'coalesce({s}.nb, [])', 'i.e = ' + repr('S'))})"
_METAL = f"CASE WHEN {_type('a', 'TransitionMetal')} THEN {_type('b', 'DativeBondPartner')} ELSE {_type('a', 'IonicTypeMetal')} AND {_type('b', 'IonicTypePartner')} END"

ATOM_SQL = {
    "molstar": {
        "HydrogenBond": _hbond_sql("HydrogenBond", "HbondDonor", 4.1, 2.0),
        "WeakHydrogenBond": _hbond_sql("WeakHydrogenBond", "WeakHbondDonor", 3.5, 0.0),
        "Hydrophobic": _pairs_sql("Hydrophobic", f"{_type('a', 'Hydrophobic')} AND {_type('b', 'Hydrophobic')} AND {D2} <= 16.0 AND NOT {_close(0)} AND NOT (a.el = 'F' AND b.el = 'F')", True),
        "Halogen": _halogen_sql(),
        "MetalCoordination": _pairs_sql("MetalCoordination", f"{_METAL} AND {D2} <= 9.0 AND NOT {_bonded('a', 'b')} AND NOT {SAME}"),
    },
    "arpeggio": {
        "HydrogenBond": _pairs_sql("HydrogenBond", f"{_type('a', 'HbondDonor')} AND {_type('b', 'HbondAcceptor')} AND {D2} <= 20.25 AND NOT {_close(1)} AND {_NEAR_H} AND {_bent(1.57)}"),
        "WeakHydrogenBond": _pairs_sql("WeakHydrogenBond", f"{_type('a', 'WeakHbondDonor')} AND {_type('b', 'HbondAcceptor')} AND {D2} <= 20.25 AND NOT {_close(1)} AND {_NEAR_H} AND {_bent(2.27)}"),
        "PolarHydrogenBond": _pairs_sql("PolarHydrogenBond", f"{_type('a', 'HbondDonor')} AND {_type('b', 'HbondAcceptor')} AND {D2} <= 12.25 AND NOT {_close(1)}"),
        "WeakPolarHydrogenBond": _pairs_sql("WeakPolarHydrogenBond", f"{_type('a', 'WeakHbondDonor')} AND {_type('b', 'HbondAcceptor')} AND {D2} <= 12.25 AND NOT {_close(1)}"),
        "Hydrophobic": _pairs_sql("Hydrophobic", f"{_type('a', 'Hydrophobic')} AND {_type('b', 'Hydrophobic')} AND {D2} <= 20.25 AND NOT {_close(1)}", True),
        "VanDerWaals": _pairs_sql("VanDerWaals", f"{NO_HYDROGEN} AND {D2} <= 20.25 AND NOT {_close(1)} AND sqrt({D2}) BETWEEN a.vdw + b.vdw AND a.vdw + b.vdw + 0.1", True),
        "Ionic": _pairs_sql("Ionic", f"{_type('a', 'PositiveCharge')} AND {_type('b', 'NegativeCharge')} AND {D2} <= 16.0 AND NOT {_close(1)}"),
        "Aromatic": _pairs_sql("Aromatic", f"{_type('a', 'Aromatic')} AND {_type('b', 'Aromatic')} AND {D2} <= 16.0 AND NOT {_close(1)}", True),
        "Carbonyl": _pairs_sql("Carbonyl", f"{_type('a', 'CarbonylCarbon')} AND {_type('b', 'CarbonylOxygen')} AND {D2} <= 12.96 AND NOT {_close(1)}"),
    },
    "getcontacts": {
        "Ionic": _pairs_sql("Ionic", f"{_type('a', 'NegativeCharge')} AND {_type('b', 'PositiveCharge')} AND {D2} <= 16.0"),
        "HydrogenBond": _pairs_sql("HydrogenBond", f"{_type('a', 'HbondDonor')} AND {_type('b', 'HbondAcceptor')} AND {D2} <= 12.25 AND a.el <> 'S' AND b.el <> 'S' AND NOT {_close(0)}"),
        "Hydrophobic": _pairs_sql("Hydrophobic", f"{_type('a', 'Hydrophobic')} AND {_type('b', 'Hydrophobic')} AND a.el = 'C' AND b.el = 'C' AND NOT {_close(1)} AND sqrt({D2}) < a.vdw + b.vdw + 0.5 AND {D2} <= 15.21", True),
        "VanDerWaals": _pairs_sql("VanDerWaals", f"{NO_HYDROGEN} AND {D2} <= 20.25 AND NOT {_close(1)} AND NOT ({_SULFUR('a')} AND {_SULFUR('b')}) AND sqrt({D2}) <= a.vdw + b.vdw + 0.5", True),
    },
}

RING, GROUP = 1 << 56, 2 << 56


def _offset(point: str, center: str, normal: str) -> str:
    d, n = _minus(point, center), tuple(f"{normal}.{c}" for c in "xyz")
    return f"sqrt(greatest(0.0, {_dot(d, d)} - CASE WHEN {_dot(n, n)} > 0 THEN {_dot(d, n)} * {_dot(d, n)} / nullif({_dot(n, n)}, 0) ELSE 0.0 END))"


_NORMAL = {s: tuple(f"{s}.nrm.{c}" for c in "xyz") for s in "ab"}
_PLANES = _angle(_NORMAL["a"], _NORMAL["b"])
_TILT = _acute(_angle(_NORMAL["b"], _minus("a", "b")))  # point a over ring b


def _rings_sql(cases: str, test: str) -> str:
    return f"WITH {ATOMS}, {RINGS}, met AS (SELECT {RING} + a.n AS lhs, {RING} + b.n AS rhs, {cases} AS type, round({D2}, 6) AS d2 FROM rng a JOIN rng b ON a.n < b.n WHERE NOT {SAME} AND {test}) SELECT * FROM met WHERE type IS NOT NULL"


def _over_ring_sql(kind: str, points: str, test: str, group: bool = False) -> str:
    ids = f"{RING} + b.n AS lhs, {GROUP} + a.n AS rhs" if group else f"a.n AS lhs, {RING} + b.n AS rhs"
    return f"WITH {ATOMS}, {RINGS} SELECT {ids}, '{kind}' AS type, round({D2}, 6) AS d2 FROM ato a JOIN rng b ON {D2} <= 36.0 WHERE {points} AND {test}"


_M_OFFSET = f"least({_offset('b', 'a', 'a.nrm')}, {_offset('a', 'b', 'b.nrm')})"
_PSI = f"least({_acute(_angle(_NORMAL['a'], _minus('b', 'a')))}, {_acute(_angle(_NORMAL['b'], _minus('a', 'b')))})"
_GC = f"CASE WHEN {_PSI} <= 45.0 AND {D2} <= 49.0 AND {_acute(_PLANES)} <= 30.0 THEN 'PiStackingP' WHEN {_PSI} <= 45.0 AND {D2} <= 25.0 AND abs({_PLANES} - 90.0) <= 30.0 THEN 'PiStackingT' END"
_IONIC = f"""WITH {ATOMS} SELECT {GROUP} + least(a.n, b.n) AS lhs, {GROUP} + greatest(a.n, b.n) AS rhs, 'Ionic' AS type, round({D2}, 6) AS d2 FROM ato a JOIN ato b ON a.n % 4 = 0 AND b.n % 4 = 3 AND {D2} <= 25.0
WHERE NOT {SAME} AND b.n <> a.n + 3 AND least({", ".join(f"(a.x+{p}-b.x-{q})*(a.x+{p}-b.x-{q})+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)" for p in (0.0, 1.5) for q in (0.0, 1.5))}) < 25.0"""


def _atom_rule(provider: str, kind: str):
    def query(spark, d):
        rules = tuple(r for r in contacts.PROVIDERS[provider].atoms if r.type == kind)
        return _rounded(contacts.atom_contacts(typed_atoms(spark, d), rules, []))

    return query


def _over_ring(name: str):
    return lambda spark, d: _rounded(contacts.arpeggio_ring_contacts(typed_atoms(spark, d), rings(spark, d), name, []))


def _ionic(spark, d):
    return _rounded(contacts.ionic_groups(groups(spark, d), []))


def _molstar_stack(spark, d):
    return _rounded(contacts.molstar_pi_stacking(rings(spark, d), []))


def _molstar_cation(spark, d):
    return _rounded(contacts.molstar_cation_pi(groups(spark, d), rings(spark, d), []))


def _gc_cation(spark, d):
    return _rounded(contacts.getcontacts_cation_pi(typed_atoms(spark, d), rings(spark, d), []))


def _gc_stack(kind: str):
    return lambda spark, d: _rounded(contacts.getcontacts_pi_stacking(rings(spark, d), []).where(F.col("type") == kind))


_GROWN = "CASE el " + " ".join(f"WHEN '{e}' THEN {r}" for e, r in AREA_RADII.items() if e in ELEMENTS) + f" ELSE 1.7 END::DOUBLE + {PROBE}"
_SURFACE = f"""WITH {ATOMS}, k AS (SELECT unnest(range({SPOTS}))::DOUBLE AS k), z AS (SELECT k, 1 - 2 * (k + 0.5) / {SPOTS} AS z FROM k),
dot AS (SELECT k, sqrt(greatest(0.0, 1 - z * z)) * cos(pi() * (3 - sqrt(5)) * k) AS u, sqrt(greatest(0.0, 1 - z * z)) * sin(pi() * (3 - sqrt(5)) * k) AS v, z AS w FROM z),
g AS (SELECT n, x, y, z, {_GROWN} AS g FROM ato), s AS (SELECT n, g, k, x + g * u AS x, y + g * v AS y, z + g * w AS z FROM g, dot),
shaded AS (SELECT DISTINCT s.n, s.k FROM s JOIN g o ON s.n <> o.n AND (s.x-o.x)*(s.x-o.x) + (s.y-o.y)*(s.y-o.y) + (s.z-o.z)*(s.z-o.z) <= o.g * o.g),
c AS (SELECT n, count(*) AS c FROM shaded GROUP BY n)
SELECT g.n AS atom_id, round(4 * pi() * g * g * ({SPOTS} - coalesce(c, 0)) / {SPOTS}, 2) AS area FROM g LEFT JOIN c USING (n)"""

_NUMBERS = {"molstar": ("m", ("HydrogenBond", "WeakHydrogenBond", "Hydrophobic", "Halogen", "MetalCoordination")), "arpeggio": ("a", tuple(ATOM_SQL["arpeggio"])), "getcontacts": ("g", ("HydrogenBond", "Hydrophobic", "Ionic", "VanDerWaals"))}
QUERIES = {f"{letter}{i + 1}_{provider}_{kind.lower()}": (_atom_rule(provider, kind), ATOM_SQL[provider][kind]) for provider, (letter, kinds) in _NUMBERS.items() for i, kind in enumerate(kinds)}
_PLAIN = f"NOT {_type('a', 'Aromatic')}"
QUERIES |= {
    "m6_molstar_pistacking": (_molstar_stack, _rings_sql(f"CASE WHEN {_acute(_PLANES)} <= 30.0 THEN 'PiStackingP' WHEN abs({_acute(_PLANES)} - 90.0) <= 30.0 THEN 'PiStackingT' END", f"{D2} <= 30.25 AND {_M_OFFSET} <= 2.0")),
    "m7_molstar_cationpi": (_molstar_cation, _over_ring_sql("CationPi", "a.n % 4 = 0", f"NOT {SAME} AND {_offset('a', 'b', 'b.nrm')} <= 2.0", True)),
    "m8_molstar_ionic": (_ionic, _IONIC),
    "r18_sasa_points": (surface, _SURFACE),
    "t16_ring_angles": (angles, f"WITH {ATOMS}, {RINGS} SELECT b.n AS point, b.n - 1 AS ring_id, round(coalesce({_angle(_minus('b', 'a'), tuple(f'a.nrm.{c}' for c in 'xyz'))}, 0.0), 5) AS angle FROM ato b LEFT JOIN rng a ON a.n = b.n - 1 WHERE b.n > 0"),
    "a10_arpeggio_donorpi": (_over_ring("DonorPi"), _over_ring_sql("DonorPi", f"{_type('a', 'HbondDonor')} AND {_PLAIN}", f"{D2} <= 20.25 AND {_TILT} <= 30.0")),
    "a11_arpeggio_sulphurpi": (_over_ring("SulphurPi"), _over_ring_sql("SulphurPi", "a.el = 'S' AND a.resname = 'MET'", "true")),
    "a12_arpeggio_carbonpi": (_over_ring("CarbonPi"), _over_ring_sql("CarbonPi", f"a.el = 'C' AND {_type('a', 'WeakHbondDonor')} AND {_PLAIN}", f"{D2} <= 20.25 AND {_TILT} <= 30.0")),
    "a13_arpeggio_cationpi": (_over_ring("CationPi"), _over_ring_sql("CationPi", f"{_type('a', 'PositiveCharge')} AND {_PLAIN}", f"{D2} <= 20.25 AND {_TILT} <= 30.0")),
    "g5_getcontacts_cationpi": (_gc_cation, _over_ring_sql("CationPi", _type("a", "PositiveCharge"), f"NOT {SAME} AND {_TILT} <= 60.0")),
    "g6_getcontacts_pistackingp": (_gc_stack("PiStackingP"), _rings_sql(f"nullif({_GC}, 'PiStackingT')", f"{D2} <= 49.0")),
    "g7_getcontacts_pistackingt": (_gc_stack("PiStackingT"), _rings_sql(f"nullif({_GC}, 'PiStackingP')", f"{D2} <= 49.0")),
}
