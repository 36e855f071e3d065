"""Non-covalent contacts: three catalogues of named rules over pairs found in blocks of space.

The typed atoms are derived once and written; all rules read that table. A provider's atom rules share one pass at
their largest radius: only atoms whose bits some rule asks for enter it, each once with what its tests need and with a
halo, and the pairs are tested where they are found (`near`, `rules`), so pairs are never shuffled. Rules of rings and of
points over rings work likewise on centres.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe import on_workers
from helixframe.functions.geometry import distance_sq
from helixframe.functions.interactions import TypeSet, entity_id
from helixframe.operators import radius
from helixframe.operators import topology as topo
from helixframe.operators.contact_set import altloc_compatible
from helixframe.operators.near import near_pairs
from helixframe.operators.rules import ARPEGGIO, GETCONTACTS, MOLSTAR, AtomRule, atom_tests, getcontacts_stack, molstar_stack, of_kinds, over_ring
from helixframe.tables import materialize

MODEL = topo.MODEL
COLUMNS = [*MODEL, "lhs", "rhs", "type", "distance_sq"]


def same_residue(a: Column, b: Column) -> Column:
    return (a["resid"] == b["resid"]) & (a["resname"] == b["resname"]) & (a["chain"] == b["chain"])


@dataclass(frozen=True)
class Provider:
    atoms: tuple[AtomRule, ...]
    types: Callable[[DataFrame], DataFrame]


PROVIDERS = {"molstar": Provider(MOLSTAR, topo.molstar_types), "arpeggio": Provider(ARPEGGIO, topo.arpeggio_types), "getcontacts": Provider(GETCONTACTS, topo.getcontacts_types)}
#: Types that ring and group rules emit, by provider; the filter tests the first name, as the rule is tagged.
OTHER = {
    "molstar": ("Ionic", "PiStacking", "CationPi"),
    "arpeggio": ("DonorPi", "SulphurPi", "CarbonPi", "CationPi"),
    "getcontacts": ("CationPi", "PiStackingP", "PiStackingT"),
}


def _asked(bits: Column, rules: tuple[AtomRule, ...]) -> Column:
    """Whether an atom can be a side of some rule."""
    names = {n for r in rules for n in (*r.left, *r.right)}
    return F.lit(True) if any(not r.left or not r.right for r in rules) else bits.bitwiseAND(F.lit(sum(topo.TYPES[n] for n in names))) != 0


def atom_contacts(typed: DataFrame, rules: tuple[AtomRule, ...], model: list[str] = MODEL) -> DataFrame:
    more = ("nbrs", "second") if any(r.bonds for r in rules) else ()
    part = typed.where(_asked(F.col("atom_type"), rules)).select(*model, F.col("atom_id").cast("long").alias("atom_id"), "x", "y", "z", "chain", "resid", "resname", "el", "altloc", "atom_type", "hyb", *more)
    found = near_pairs(part, max(r.reach for r in rules), model, tuple(r.type for r in rules), atom_tests(rules))
    return found.select(*model, entity_id("atom", F.col("i")).alias("lhs"), entity_id("atom", F.col("j")).alias("rhs"), "type", "distance_sq")


def _ring_part(rings: DataFrame, model: list[str]) -> DataFrame:
    return rings.select(*model, F.col("ring_id").cast("long").alias("atom_id"), *[F.col(f"center.{c}").alias(c) for c in "xyz"], "chain", "resid", "resname", *[F.col(f"normal.{c}").cast("double").alias(f"n{c}") for c in "xyz"])


def ring_contacts(rings: DataFrame, reach: float, kinds: tuple[str, ...], classify: Callable, model: list[str] = MODEL) -> DataFrame:
    """Contacts between rings; classify gives the number of each pair's kind (see `rules`)."""
    found = near_pairs(_ring_part(rings, model), reach, model, kinds, of_kinds(classify))
    return found.select(*model, entity_id("ring", F.col("i")).alias("lhs"), entity_id("ring", F.col("j")).alias("rhs"), "type", "distance_sq")


def mixed_contacts(points: DataFrame, kind: str, rings: DataFrame, reach: float, name: str, classify: Callable, model: list[str] = MODEL) -> DataFrame:
    """Contacts of one type between points (id, x, y, z, chain, resid, resname) of a kind and rings."""
    nowhere = [F.lit(None).cast("double").alias(f"n{c}") for c in "xyz"]
    left = points.select(*model, F.col("id").cast("long").alias("atom_id"), *[F.col(c).cast("double").alias(c) for c in "xyz"], "chain", "resid", "resname", *nowhere, F.lit(0).alias("side"))
    both = left.unionByName(_ring_part(rings, model).withColumn("side", F.lit(1)))
    found = near_pairs(both, reach, model, (name,), of_kinds(classify), True)
    left, right = entity_id(kind, F.col("i")), entity_id("ring", F.col("j"))
    return found.select(*model, F.least(left, right).alias("lhs"), F.greatest(left, right).alias("rhs"), "type", "distance_sq")


def _points(rows: DataFrame, key: str, model: list[str]) -> DataFrame:
    return rows.select(*model, F.col(key).alias("id"), "x", "y", "z", "chain", "resid", "resname")


def ionic_groups(groups: DataFrame, model: list[str] = MODEL) -> DataFrame:
    """Positive and negative groups with centroids within 5 and some members nearer than 5, whose first atoms aren't bonded."""
    part = lambda kind: groups.where(F.col("kind") == kind).select(*model, F.col("group_id").alias("id"), "x", "y", "z", F.struct("chain", "resid", "resname", "points", "atom_ids", "first_bonds").alias("f"))
    pairs = radius.cross_join(part("positive"), part("negative"), 5.0, model, key="id", keep=["f"])
    near = F.exists(F.col("f_i.points"), lambda p: F.exists(F.col("f_j.points"), lambda q: distance_sq(p, q) < 25.0))
    bound = F.coalesce(F.array_contains(F.col("f_i.first_bonds"), F.col("f_j.atom_ids")[0]), F.lit(False))
    kept = pairs.where(near & ~bound & ~same_residue(F.col("f_i"), F.col("f_j")))
    left, right = entity_id("group", F.col("i")), entity_id("group", F.col("j"))
    return kept.select(*model, F.least(left, right).alias("lhs"), F.greatest(left, right).alias("rhs"), F.lit("Ionic").alias("type"), "distance_sq")


def molstar_pi_stacking(rings: DataFrame, model: list[str] = MODEL) -> DataFrame:
    return ring_contacts(rings, 5.5, ("PiStackingP", "PiStackingT"), molstar_stack, model)


def molstar_cation_pi(groups: DataFrame, rings: DataFrame, model: list[str] = MODEL) -> DataFrame:
    """Positive groups near a ring's axis."""
    return mixed_contacts(_points(groups.where("kind = 'positive'"), "group_id", model), "group", rings, 6.0, "CationPi", over_ring(36.0, offset=2.0, apart=True), model)


def arpeggio_ring_contacts(typed: DataFrame, rings: DataFrame, name: str, model: list[str] = MODEL) -> DataFrame:
    """DonorPi, CarbonPi, CationPi or SulphurPi: atoms over a ring."""
    bit = lambda n: topo.has(F.col("atom_type"), n)
    sides = {"DonorPi": bit("HbondDonor") & ~bit("Aromatic"), "CarbonPi": (F.col("el") == "C") & bit("WeakHbondDonor") & ~bit("Aromatic"), "CationPi": bit("PositiveCharge") & ~bit("Aromatic"), "SulphurPi": (F.col("el") == "S") & (F.col("resname") == "MET")}
    points = _points(typed.where(sides[name]), "atom_id", model)
    if name == "SulphurPi":
        return mixed_contacts(points, "atom", rings, 6.0, name, over_ring(36.0), model)
    return mixed_contacts(points, "atom", rings, 4.5, name, over_ring(20.25, most=30.0), model)


def getcontacts_cation_pi(typed: DataFrame, rings: DataFrame, model: list[str] = MODEL) -> DataFrame:
    return mixed_contacts(_points(typed.where(topo.has(F.col("atom_type"), "PositiveCharge")), "atom_id", model), "atom", rings, 6.0, "CationPi", over_ring(36.0, most=60.0, apart=True), model)


def getcontacts_pi_stacking(rings: DataFrame, model: list[str] = MODEL) -> DataFrame:
    return ring_contacts(rings, 7.0, ("PiStackingP", "PiStackingT"), getcontacts_stack, model)


def contacts(atoms: DataFrame, provider: str = "molstar", only: TypeSet | None = None, model: list[str] = MODEL, bond: DataFrame | None = None) -> DataFrame:
    """(model, lhs, rhs, type, distance_sq) of a provider's rules, or of those whose tag is in `only`.

    Rules that aren't asked for are not planned at all. The atoms and the typed atoms are written to the shared folder.
    bond gives bonds (model, a, b) that are known, as those of predicted models are; without it they are sought.
    """
    if provider not in PROVIDERS:
        raise ValueError(f"one of {', '.join(PROVIDERS)}")
    wanted = lambda name: only is None or name in only
    chosen = PROVIDERS[provider]
    rules = tuple(r for r in chosen.atoms if wanted(r.type))
    on_workers(atoms.sparkSession)
    atoms = materialize(atoms, "atoms")
    feature = typed = materialize(chosen.types(topo.features(atoms, bond, model)), "typed-atoms")
    out = [atom_contacts(typed, rules, model)] if rules else []
    extra = [t for t in OTHER[provider] if wanted(t)]
    rings = topo.rings(atoms, model, feature) if set(extra) - {"Ionic"} else None
    if provider == "molstar":
        groups = topo.charge_groups(feature, model) if set(extra) & {"Ionic", "CationPi"} else None
        if "Ionic" in extra:
            out.append(ionic_groups(groups, model))
        if "PiStacking" in extra:
            out.append(molstar_pi_stacking(rings, model))
        if "CationPi" in extra:
            out.append(molstar_cation_pi(groups, rings, model))
    elif provider == "arpeggio":
        out += [arpeggio_ring_contacts(typed, rings, name, model) for name in extra]
    else:
        if "CationPi" in extra:
            out.append(getcontacts_cation_pi(typed, rings, model))
        if set(extra) & {"PiStackingP", "PiStackingT"}:
            out.append(getcontacts_pi_stacking(rings, model).where(F.col("type").isin(*extra)))
    if not out:
        return atom_contacts(typed, chosen.atoms[:1], model).limit(0)
    total = out[0]
    for more in out[1:]:
        total = total.unionByName(more)
    return total


def find_contacts(left: DataFrame, right: DataFrame | None, reach: float, tester: Callable[[Column, Column, Column], Column] | None = None, model: list[str] = MODEL, key: str = "atom_id") -> DataFrame:
    """Pairs of filtered entities within `reach` that a tester accepts, with the tester's type (Generic by default).

    left and right have model, key, x, y, z and optionally altloc; the tester gets both sides as structs of
    their columns and the squared distance and returns a type name or null. With right None it is a self
    join. A pair that a cross join meets in both orientations counts once.
    """
    pack = lambda df: df.select(*model, key, "x", "y", "z", F.struct(*[F.col(c) for c in df.columns]).alias("f"))
    if right is None:
        pairs = radius.self_join(pack(left), reach, model, key, keep=["f"])
    else:
        pairs = radius.cross_join(pack(left), pack(right), reach, model, key, residual=F.col(f"a.{key}") != F.col(f"b.{key}"), keep=["f"])
    if "altloc" in left.columns:
        pairs = pairs.where(altloc_compatible(F.col("f_i.altloc"), F.col("f_j.altloc")))
    kind = tester(F.col("f_i"), F.col("f_j"), F.col("distance_sq")) if tester else F.lit("Generic")
    typed = pairs.withColumn("type", kind).where("type is not null")
    return typed.select(*model, F.least("i", "j").alias("lhs"), F.greatest("i", "j").alias("rhs"), "type", "distance_sq").dropDuplicates([*model, "lhs", "rhs"])


def residue_gap_neighbours(atoms: DataFrame, cutoff: float, difference: int = 0, model: list[str] = MODEL) -> DataFrame:
    """Neighbour pairs; with a difference k > 0 without hydrogens and without pairs of polymer residues at most k apart."""
    part = atoms.where(~topo.upper_element().isin("H", "D")) if difference > 0 else atoms
    rows = part.select(*model, "atom_id", "x", "y", "z", "resid", topo.is_polymer(F.col("resname")).alias("polymer"))
    far = (F.abs(F.col("a.resid") - F.col("b.resid")) > difference) | ~F.col("a.polymer") | ~F.col("b.polymer")
    return radius.self_join(rows, cutoff, model, residual=far if difference > 0 else None)
