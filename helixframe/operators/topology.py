"""Chemistry of structures as tables: residues, bonds, neighbours, hybridisation, rings, charge groups, atom types.

Everything is joins and aggregations keyed by (model_id, frame), so one huge assembly spreads over its
cells and residues, and only the tables a query asks for are computed. Standard residues follow templates;
other residues are judged by elements, neighbour counts and bond lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.geometry import centroid, ring_normal
from helixframe.operators import radius
from helixframe.operators.contact_set import altloc_compatible
from helixframe.operators.kernels import Grid, in_blocks, whole_groups

MODEL = ["model_id", "frame"]
RESIDUE = ["chain", "resid", "resname"]

# The bits of atom types.
TYPES = {
    "HbondAcceptor": 1, "HbondDonor": 2, "WeakHbondAcceptor": 4, "WeakHbondDonor": 8, "PositiveCharge": 16, "NegativeCharge": 32, "CarbonylOxygen": 64,
    "CarbonylCarbon": 128, "Aromatic": 256, "Hydrophobic": 512, "XBondAcceptor": 1024, "XbondDonor": 2048, "IonicTypePartner": 4096, "DativeBondPartner": 8192,
    "TransitionMetal": 16384, "IonicTypeMetal": 32768, "Invalid": 65536,
}
# Single-bond covalent radii (Cordero et al. 2008) and van der Waals radii (Bondi 1964, Alvarez 2013).
COVALENT = {"H": 0.31, "D": 0.31, "B": 0.84, "C": 0.76, "N": 0.71, "O": 0.66, "F": 0.57, "SI": 1.11, "P": 1.07, "S": 1.05, "CL": 1.02, "SE": 1.20, "BR": 1.20, "I": 1.39}
VDW = {"H": 1.2, "D": 1.2, "B": 1.92, "C": 1.7, "N": 1.55, "O": 1.52, "F": 1.47, "SI": 2.1, "P": 1.8, "S": 1.8, "CL": 1.75, "SE": 1.9, "BR": 1.85, "I": 1.98}
BOND_SLACK, BOND_REACH = 0.45, 3.3
BLOCK = 40.0  # width of the blocks of space in which bonds are sought

# Element groups.
METALS_IONIC = ("LI", "NA", "K", "RB", "CS", "MG", "CA", "SR", "BA", "AL", "GA", "IN", "TL", "SC", "SN", "PB", "BI", "SB", "HG")
METALS_TRANSITION = ("TI", "V", "CR", "MN", "FE", "CO", "NI", "CU", "Y", "ZR", "NB", "MO", "TC", "RU", "RH", "PD", "AG", "HF", "TA", "W", "RE", "OS", "IR", "PT", "AU", "ZN", "CD")
WATER = ("HOH", "W", "SOL", "TIP3", "SPC", "H2O", "TIP4", "TIP", "DOD", "D3O", "WAT")
PROTEIN = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL")
PROTEIN_MORE = ("MSE", "SEC", "PYL", "ASX", "GLX", "HID", "HIE", "HIP", "CYX", "CYM", "ASH", "GLH", "LYN")
BASES = ("A", "C", "G", "U", "I", "T", "DA", "DC", "DG", "DT", "DU", "DI", "N", "DN")
BACKBONE = ("N", "CA", "C", "O", "OXT", "H", "HA")
NUCLEIC_BACKBONE = ("P", "OP1", "OP2", "O1P", "O2P", "O5'", "C5'", "C4'", "O4'", "C3'", "O3'", "C2'", "O2'", "C1'")

# Atoms of rings in order, by residue.
SIX = ("N1", "C2", "N3", "C4", "C5", "C6")
RINGS = {
    "PHE": (("CG", "CD1", "CE1", "CZ", "CE2", "CD2"),),
    "TYR": (("CG", "CD1", "CE1", "CZ", "CE2", "CD2"),),
    "HIS": (("CG", "ND1", "CE1", "NE2", "CD2"),),
    "TRP": (("CG", "CD1", "NE1", "CE2", "CD2"), ("CD2", "CE2", "CZ2", "CH2", "CZ3", "CE3")),
} | {b: (SIX, ("C4", "C5", "N7", "C8", "N9")) for b in ("A", "G", "I", "DA", "DG", "DI")} | {b: (SIX,) for b in ("C", "U", "T", "DC", "DT", "DU")}

# Side-chain atoms with three directions in a plane.
PLANAR = {
    "ASP": ("CG", "OD1", "OD2"), "ASN": ("CG", "OD1", "ND2"), "GLU": ("CD", "OE1", "OE2"), "GLN": ("CD", "OE1", "NE2"), "ARG": ("NE", "CZ", "NH1", "NH2"),
    "HIS": ("CG", "ND1", "CE1", "NE2", "CD2"), "PHE": ("CG", "CD1", "CE1", "CZ", "CE2", "CD2"), "TYR": ("CG", "CD1", "CE1", "CZ", "CE2", "CD2", "OH"),
    "TRP": ("CG", "CD1", "NE1", "CE2", "CD2", "CE3", "CZ2", "CH2", "CZ3"),
}
# Hydrogens on side-chain nitrogen, oxygen and sulfur.
HYDROGENS = {
    ("LYS", "NZ"): 3, ("ARG", "NE"): 1, ("ARG", "NH1"): 2, ("ARG", "NH2"): 2, ("ASN", "ND2"): 2, ("GLN", "NE2"): 2, ("HIS", "ND1"): 1, ("HIS", "NE2"): 1,
    ("TRP", "NE1"): 1, ("SER", "OG"): 1, ("THR", "OG1"): 1, ("TYR", "OH"): 1, ("CYS", "SG"): 1,
}


def upper_element() -> Column:
    return F.upper(F.trim("element"))


def lookup(table: dict, key: Column, default=None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def is_polymer(resname: Column) -> Column:
    return resname.isin(*PROTEIN, *PROTEIN_MORE, *BASES)


def residue_class(resname: Column) -> Column:
    """water, protein, base or other."""
    return F.when(resname.isin(*WATER), "water").when(resname.isin(*PROTEIN, *PROTEIN_MORE), "protein").when(resname.isin(*BASES), "base").otherwise("other")


def residues(atoms: DataFrame, model: list[str] = MODEL) -> DataFrame:
    """(model, res_idx, chain, resid, resname, n_atoms): dense index by first appearance."""
    found = atoms.groupBy(*model, *RESIDUE).agg(F.min("atom_id").alias("__first"), F.count(F.lit(1)).alias("n_atoms"))
    index = F.row_number().over(Window.partitionBy(*model).orderBy("__first")) - 1
    return found.select(*model, index.alias("res_idx"), *RESIDUE, "n_atoms")


def factorize(rows: DataFrame, keys: list[str], order: str, model: list[str] | None = None, name: str = "factor") -> DataFrame:
    """rows with a dense first-seen number of their key, per model; without models the keys are numbered in ranges, not in one task."""
    model = model or []
    firsts = rows.groupBy(*model, *keys).agg(F.min(order).alias("__first"))
    if not model:
        return rows.join(radius.renumber(firsts, "__first", name).drop("__first"), keys)
    window = Window.partitionBy(*model).orderBy("__first")
    return rows.join(firsts.withColumn(name, F.row_number().over(window) - 1).drop("__first"), [*model, *keys])


def bonds(atoms: DataFrame, model: list[str] = MODEL, ends: bool = False) -> DataFrame:
    """(model, a, b): pairs closer than their covalent radii and a slack; no metals, no two hydrogens, compatible alternates.

    With ends also end_a and end_b: atom_id, element, x, y, z of either atom; they take a grid join. Without them atoms move
    once, to blocks of space.
    """
    if not ends:
        each = near_atoms(atoms, model).select(*model, F.col("atom_id").alias("a"), F.explode("nbrs.atom_id").alias("b")).where("a < b")
        kind = dict(atoms.dtypes)["atom_id"]
        return each.select(*model, F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))
    part = atoms.select(*model, "atom_id", "x", "y", "z", "altloc", upper_element().alias("element"), lookup(COVALENT, upper_element()).alias("cov"), upper_element().isin("H", "D").alias("h")).where("cov is not null")
    reach = F.col("a.cov") + F.col("b.cov") + BOND_SLACK
    d2 = sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in "xyz"), F.lit(0.0))
    test = ~(F.col("a.h") & F.col("b.h")) & altloc_compatible(F.col("a.altloc"), F.col("b.altloc")) & (d2 <= reach * reach)
    found = radius.self_join(part, BOND_REACH, model, residual=test, keep=["element", *"xyz"])
    end = lambda key, o, name: F.struct(F.col(key).alias("atom_id"), F.col(f"element_{o}").alias("element"), *[F.col(f"{c}_{o}").alias(c) for c in "xyz"]).alias(name)
    return found.select(*model, F.col("i").alias("a"), F.col("j").alias("b"), end("i", "i", "end_a"), end("j", "j", "end_b"))


def neighbours(atoms: DataFrame, bond: DataFrame, model: list[str] = MODEL) -> DataFrame:
    """(model, atom_id, nbrs): nbrs holds atom_id, element, x, y, z of each bonded atom, in order. Bonds that carry their ends need no join."""
    if "end_a" not in bond.columns:
        end = atoms.select(*model, F.col("atom_id").alias("id"), F.struct("atom_id", upper_element().alias("element"), "x", "y", "z").alias("end"))
        for side in ("a", "b"):
            bond = bond.join(radius.unsent(end.withColumnsRenamed({"id": side, "end": f"end_{side}"})), [*model, side])
    sides = F.array(F.struct(F.col("a").alias("u"), F.col("end_b").alias("v")), F.struct(F.col("b").alias("u"), F.col("end_a").alias("v")))
    both = bond.select(*model, F.explode(sides).alias("e")).select(*model, "e.u", "e.v")
    return both.groupBy(*model, F.col("u").alias("atom_id")).agg(F.array_sort(F.collect_list("v")).alias("nbrs"))


def _bonded_batches(batches: Iterator, keys: list[str]) -> Iterator:
    """(keys, atom_id, nbrs) of the blocks' own atoms that have bonds."""
    import numpy as np
    import pyarrow as pa

    for table, group in whole_groups(batches, [*keys, "block"]):
        column = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)  # noqa: B023, E731
        xyz, cov, h = np.stack([column(c) for c in "xyz"], axis=1), column("cov"), column("h")
        altloc = table.column("altloc").combine_chunks().dictionary_encode().indices.to_numpy()
        empty = column("altloc").astype(str) == ""
        atom = column("atom_id")
        own = np.flatnonzero(column("own"))
        if not len(own):
            continue
        i, j, d2 = Grid(xyz, group, BOND_REACH).pairs(own)
        a = own[i]
        keep = (d2 <= (cov[a] + cov[j] + BOND_SLACK) ** 2) & ~(h[a] & h[j]) & (empty[a] | empty[j] | (altloc[a] == altloc[j]))
        i, j = i[keep], j[keep]
        order = np.lexsort((atom[j], i))
        i, j = i[order], j[order]
        who, counts = np.unique(i, return_counts=True)
        ends = pa.StructArray.from_arrays([table.column(c).combine_chunks().take(pa.array(j)) for c in ("atom_id", "element", "x", "y", "z")], ["atom_id", "element", "x", "y", "z"])
        nbrs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), ends)
        kept = table.select([*keys, "atom_id"]).take(pa.array(own[who])).combine_chunks()
        yield from kept.append_column("nbrs", nbrs).to_batches()


def near_atoms(atoms: DataFrame, model: list[str] = MODEL) -> DataFrame:
    """What `neighbours` gives for the bonds by distance, found for blocks of space on a grid: atoms move once, with a thin halo."""
    part = atoms.select(*model, F.col("atom_id").cast("long").alias("atom_id"), *[F.col(c).cast("double").alias(c) for c in "xyz"], F.coalesce("altloc", F.lit("")).alias("altloc"), upper_element().alias("element"), lookup(COVALENT, upper_element()).alias("cov"), upper_element().isin("H", "D").alias("h"))
    kinds = dict(part.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*model, "atom_id"))
    dealt = in_blocks(part.where("cov is not null"), model, BOND_REACH, BLOCK)
    return dealt.mapInArrow(lambda b: _bonded_batches(b, model), f"{schema}, nbrs array<struct<atom_id: long, element: string, x: double, y: double, z: double>>")


def attach(rows: DataFrame, more: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """rows with the further columns of more, which has one row per key; an equi-join by one number."""
    a, b = radius.keyed_by(rows, on).alias("a"), radius.keyed_by(more, on).alias("b")
    return a.join(radius.unsent(b), radius.same_key(on), how).select(*[F.col(f"a.{c}") for c in rows.columns], *[F.col(f"b.{c}") for c in more.columns if c not in on])


def _named(table: dict) -> Column:
    """Whether (resname, name) is in residue -> names."""
    return F.concat_ws(":", "resname", "name").isin(*[f"{r}:{n}" for r, names in table.items() for n in names])


def features(atoms: DataFrame, bond: DataFrame | None = None, model: list[str] = MODEL) -> DataFrame:
    """atoms with nbrs, second, el, n_heavy, n_h (explicit), implicit_h, hyb (1 SP, 2 SP2, 3 SP3), rclass.

    Without bonds they are found by distance. second is, for an atom with one heavy neighbour, a further heavy neighbour of that one: with it such an
    atom has a plane.
    """
    near = near_atoms(atoms, model) if bond is None else neighbours(atoms, bond, model)
    heavy = lambda n: ~n["element"].isin("H", "D")
    ends = near.where(F.size(F.filter("nbrs", heavy)) == 1).select(*model, "atom_id", F.filter("nbrs", heavy)[0]["atom_id"].alias("__of"))
    beyond = attach(ends, near.withColumnsRenamed({"atom_id": "__of", "nbrs": "__nbrs"}), [*model, "__of"], "inner")
    second = beyond.select(*model, "atom_id", F.filter("__nbrs", lambda n: heavy(n) & (n["atom_id"] != F.col("atom_id"))).alias("__s")).select(*model, "atom_id", F.when(F.size("__s") > 0, F.col("__s")[0]).alias("second"))
    found = attach(attach(atoms, near, [*model, "atom_id"]), second, [*model, "atom_id"])
    count = lambda test: F.when(F.col("nbrs").isNull(), 0).otherwise(F.size(F.filter("nbrs", test)))
    counted = found.withColumns({
        "el": upper_element(), "rclass": residue_class(F.col("resname")),
        "n_heavy": count(lambda n: ~n["element"].isin("H", "D")),
        "n_h": count(lambda n: n["element"].isin("H", "D")),
        "n_no": count(lambda n: n["element"].isin("N", "O")),
        "n_not_c": count(lambda n: ~n["element"].isin("C", "H", "D")),
        "n_halogen_binder": count(lambda n: n["element"].isin("C", "N", "P", "S")),
    })
    d2 = lambda n: (n["x"] - F.col("x")) ** 2 + (n["y"] - F.col("y")) ** 2 + (n["z"] - F.col("z")) ** 2
    short = F.coalesce(F.exists("nbrs", lambda n: ~n["element"].isin("H", "D") & (d2(n) < 1.42**2)), F.lit(False))
    double = F.coalesce(F.exists("nbrs", lambda n: ~n["element"].isin("H", "D") & (d2(n) < 1.32**2)), F.lit(False))
    backbone_flat = (F.col("rclass") == "protein") & F.col("name").isin("N", "C", "O", "OXT")
    hyb = (
        F.when(backbone_flat | _named(PLANAR), 2).when(F.col("rclass") == "protein", 3).when(F.col("rclass") == "water", 3)
        .when((F.col("rclass") == "base") & ~F.col("name").isin(*NUCLEIC_BACKBONE), 2)
        .when(F.col("el").isin("C", "N") & (F.col("n_heavy") <= 3) & short, 2).when((F.col("el") == "O") & double, 2).otherwise(3)
    )
    sited = counted.withColumn("hyb", hyb)
    scope = F.concat_ws("|", "chain", F.when(F.col("rclass").isin("protein", "base"), "polymer").otherwise(F.concat_ws("|", F.lit("residue"), "resid", "resname")))
    hydrogens = atoms.where(upper_element().isin("H", "D")).withColumn("rclass", residue_class(F.col("resname"))).select(*model, scope.alias("h_scope")).distinct().withColumn("explicit", F.lit(True))
    sited = sited.withColumn("h_scope", scope).join(radius.unsent(hydrogens), [*model, "h_scope"], "left").drop("h_scope")  # where no structure has hydrogens this table is empty
    explicit = F.coalesce("explicit", F.lit(False))
    table = {f"{r}:{n}": h for (r, n), h in HYDROGENS.items()}
    side = lookup(table, F.concat_ws(":", "resname", "name"))
    bonded = F.col("n_heavy")
    room = F.when(F.col("el") == "C", F.when(F.col("hyb") == 2, 3).otherwise(4)).when(F.col("el") == "N", 3).when(F.col("el").isin("O", "S"), F.when((F.col("hyb") == 2) & (F.col("el") == "O"), 1).otherwise(2)).otherwise(0)
    generic = F.greatest(F.lit(0), room - bonded)
    model_h = (
        F.when(F.col("rclass") == "water", F.when(F.col("el") == "O", 2).otherwise(0))
        .when((F.col("rclass") == "protein") & (F.col("name") == "N"), F.when(F.col("resname") == "PRO", 0).when(bonded <= 1, 3).otherwise(1))
        .when((F.col("resname") == "CYS") & (F.col("name") == "SG"), F.when(bonded >= 2, 0).otherwise(1))
        .when(side.isNotNull(), side)
        .when((F.col("rclass") == "protein") & F.col("el").isin("N", "O", "S"), 0)
        .when((F.col("rclass") == "base") & (F.col("el") == "O"), F.when((F.col("name") == "O2'") & (bonded == 1), 1).otherwise(0))
        .when((F.col("rclass") == "base") & (F.col("el") == "N"), F.when(bonded == 1, 2).when((bonded == 2) & ((F.col("name") == "N1") & F.col("resname").isin("G", "DG", "I", "DI") | (F.col("name") == "N3") & F.col("resname").isin("U", "T", "DT", "DU")), 1).otherwise(0))
        .when((F.col("el") == "N") & (F.col("hyb") == 2) & (bonded == 2), 0)
        .otherwise(generic)
    )
    return sited.withColumn("implicit_h", F.when(explicit, 0).otherwise(model_h).cast("int")).drop("explicit")


def _bits(tests: dict[str, Column]) -> Column:
    out = F.lit(0)
    for name, test in tests.items():
        out = out.bitwiseOR(F.when(test, TYPES[name]).otherwise(0))
    return out


def molstar_types(feature: DataFrame) -> DataFrame:
    """feature with atom_type by element, hydrogens and neighbours."""
    el, name, res = F.col("el"), F.col("name"), F.col("resname")
    h = F.col("n_h") + F.col("implicit_h")
    his = (res == "HIS") & (el == "N") & name.isin("ND1", "NE2")
    total = F.col("n_heavy") + h
    lone = (F.coalesce(F.col("formal_charge"), F.lit(0)) < 1) & (((F.col("hyb") == 3) & (total < 4)) | ((F.col("hyb") == 2) & (total < 3)) | ((F.col("hyb") == 1) & (total < 2)))
    protein, base = F.col("rclass") == "protein", F.col("rclass") == "base"
    free = ~protein & ~base
    spine = name.isin("N", "CA", "C", "O", "OXT")
    oxygen_side = res.isin("ASP", "GLU", "SER", "THR", "TYR", "ASN", "GLN")
    dative = (
        (free & el.isin("F", "CL", "BR", "I", "AT", "O", "S", "N"))
        | (protein & (((el == "O") & (oxygen_side | spine)) | ((el == "S") & res.isin("CYS", "MET")) | ((el == "N") & (res == "HIS") & ~spine)))
        | (base & (((el == "O") & name.isin(*NUCLEIC_BACKBONE)) | name.isin("N3", "N4", "N7", "O2", "O4", "O6")))
    )
    ionic = dative & (el != "N")
    near_polar = F.col("n_no") > 0
    his_or_trp = _named({"HIS": ("CG", "CD2", "CE1"), "TRP": ("CG", "CD1", "CD2", "CE2")})
    return feature.withColumn("atom_type", _bits({
        "HbondDonor": his | ((h > 0) & el.isin("N", "O", "S")),
        "HbondAcceptor": (el == "O") | his | ((el == "N") & lone) | ((el == "S") & (res.isin("CYS", "MET") | (F.coalesce(F.col("formal_charge"), F.lit(0)) == -1))),
        "WeakHbondDonor": (el == "C") & (h > 0) & (near_polar | his_or_trp),
        "Hydrophobic": (el == "F") | ((el == "C") & (F.col("n_not_c") == 0)),
        "XbondDonor": el.isin("CL", "BR", "I"),
        "XBondAcceptor": el.isin("N", "O", "S") & (F.col("n_halogen_binder") > 0),
        "IonicTypeMetal": el.isin(*METALS_IONIC), "TransitionMetal": el.isin(*METALS_TRANSITION),
        "DativeBondPartner": dative, "IonicTypePartner": ionic,
    }))


# Types of protein atoms by name and residues (Jubb et al. 2017); "*" stands for all others, no name for no type.
NAMED_TYPES = {
    "N": {"PRO": "", "*": "HbondDonor"},
    "O": {"*": "HbondAcceptor WeakHbondAcceptor CarbonylOxygen XBondAcceptor"},
    "C": {"*": "CarbonylCarbon"},
    "CA": {"*": "WeakHbondDonor"},
    "CB": {"SER THR TYR": "WeakHbondDonor", "*": "WeakHbondDonor Hydrophobic"},
    "CD": {"LYS": "WeakHbondDonor Hydrophobic", "ARG PRO": "WeakHbondDonor"},
    "CD1": {"TRP": "Aromatic", "LEU ILE": "WeakHbondDonor Hydrophobic", "TYR PHE": "WeakHbondDonor Aromatic Hydrophobic"},
    "CD2": {"LEU": "WeakHbondDonor Hydrophobic", "TYR PHE": "WeakHbondDonor Aromatic Hydrophobic", "TRP": "Aromatic Hydrophobic", "HIS": "HbondAcceptor HbondDonor WeakHbondAcceptor PositiveCharge Aromatic XBondAcceptor"},
    "CE1": {"HIS": "HbondAcceptor HbondDonor WeakHbondAcceptor PositiveCharge Aromatic XBondAcceptor", "PHE TYR": "WeakHbondDonor Aromatic Hydrophobic"},
    "CE2": {"TRP": "Aromatic", "PHE TYR": "WeakHbondDonor Aromatic Hydrophobic"},
    "CE3": {"TRP": "Aromatic Hydrophobic"},
    "CE": {"MET": "WeakHbondDonor Hydrophobic", "LYS": "WeakHbondDonor"},
    "CG": {"ARG GLN GLU LEU LYS MET PRO": "WeakHbondDonor Hydrophobic", "PHE": "WeakHbondDonor Aromatic Hydrophobic", "TRP TYR": "Aromatic Hydrophobic", "HIS": "PositiveCharge Aromatic"},
    "CG1": {"ILE VAL": "WeakHbondDonor Hydrophobic"},
    "CG2": {"ILE VAL THR": "WeakHbondDonor Hydrophobic"},
    "CH2": {"TRP": "WeakHbondDonor Aromatic Hydrophobic"},
    "CZ": {"ARG": "PositiveCharge", "PHE": "WeakHbondDonor Aromatic Hydrophobic", "TYR": "Aromatic"},
    "CZ2": {"TRP": "WeakHbondDonor Aromatic Hydrophobic"},
    "CZ3": {"TRP": "WeakHbondDonor Aromatic Hydrophobic"},
    "ND1": {"HIS": "HbondAcceptor HbondDonor WeakHbondAcceptor PositiveCharge Aromatic XBondAcceptor"},
    "ND2": {"ASN": "HbondAcceptor HbondDonor WeakHbondAcceptor XBondAcceptor"},
    "NE1": {"TRP": "HbondDonor Aromatic"},
    "NE2": {"GLN": "HbondAcceptor HbondDonor WeakHbondAcceptor XBondAcceptor", "HIS": "HbondAcceptor HbondDonor WeakHbondAcceptor PositiveCharge Aromatic XBondAcceptor"},
    "NE": {"ARG": "HbondDonor PositiveCharge"},
    "NH1": {"ARG": "HbondDonor PositiveCharge"},
    "NH2": {"ARG": "HbondDonor PositiveCharge"},
    "NZ": {"LYS": "HbondDonor PositiveCharge"},
    "OD1": {"ASN": "HbondAcceptor HbondDonor WeakHbondAcceptor XBondAcceptor", "ASP": "HbondAcceptor WeakHbondAcceptor NegativeCharge XBondAcceptor"},
    "OD2": {"ASP": "HbondAcceptor WeakHbondAcceptor NegativeCharge XBondAcceptor"},
    "OE1": {"GLN": "HbondAcceptor HbondDonor WeakHbondAcceptor XBondAcceptor", "GLU": "HbondAcceptor WeakHbondAcceptor NegativeCharge XBondAcceptor"},
    "OE2": {"GLU": "HbondAcceptor WeakHbondAcceptor NegativeCharge XBondAcceptor"},
    "OG1": {"THR": "HbondAcceptor HbondDonor WeakHbondAcceptor XBondAcceptor"},
    "OG": {"SER": "HbondAcceptor HbondDonor WeakHbondAcceptor XBondAcceptor"},
    "OH": {"TYR": "HbondAcceptor HbondDonor WeakHbondAcceptor XBondAcceptor"},
    "SD": {"MET": "HbondAcceptor WeakHbondAcceptor Hydrophobic XBondAcceptor"},
    "SG": {"CYS": "HbondAcceptor HbondDonor WeakHbondAcceptor XBondAcceptor"},
    "OXT": {"*": "HbondAcceptor WeakHbondAcceptor XBondAcceptor"},
}


def arpeggio_types(feature: DataFrame) -> DataFrame:
    """feature with atom_type by name for the standard residues, by element and neighbours for others."""
    bits = lambda names: sum(TYPES[t] for t in names.split())
    named = {f"{r}:{n}": bits(names) for n, by in NAMED_TYPES.items() for rs, names in by.items() for r in rs.split() if r != "*"}
    rest = {n: bits(by["*"]) for n, by in NAMED_TYPES.items() if "*" in by}
    known = F.coalesce(lookup(named, F.concat_ws(":", "resname", "name")), lookup(rest, F.col("name")), F.lit(0))
    el, h = F.col("el"), F.col("n_h") + F.col("implicit_h")
    other = _bits({
        "HbondDonor": el.isin("N", "O", "S") & (h > 0), "HbondAcceptor": (el == "O") | ((el == "N") & (F.col("hyb") == 2) & (F.col("n_heavy") + h < 3)),
        "WeakHbondAcceptor": el.isin("O", "CL", "BR", "I", "F"), "WeakHbondDonor": (el == "C") & (h > 0), "Hydrophobic": (el == "C") & (F.col("n_not_c") == 0),
        "XBondAcceptor": el.isin("N", "O", "S"), "XbondDonor": el.isin("CL", "BR", "I"), "PositiveCharge": F.coalesce(F.col("formal_charge"), F.lit(0)) > 0,
        "NegativeCharge": F.coalesce(F.col("formal_charge"), F.lit(0)) < 0,
    })
    return feature.withColumn("atom_type", F.when(F.col("resname").isin(*PROTEIN), known).otherwise(other))


def getcontacts_types(feature: DataFrame) -> DataFrame:
    """feature with atom_type: charged sites by name, donors and acceptors with both backbone roles of N, hydrophobic residues."""
    el, name, res = F.col("el"), F.col("name"), F.col("resname")
    h = F.col("n_h") + F.col("implicit_h")
    his = res.isin("HIS", "HID", "HIE", "HIP") & name.isin("ND1", "NE2")
    free = ~F.col("rclass").isin("protein", "base")
    charge = F.coalesce(F.col("formal_charge"), F.lit(0))
    lone = (el == "N") & (charge <= 0) & (((F.col("hyb") == 3) & (F.col("n_heavy") + h < 4)) | ((F.col("hyb") == 2) & (F.col("n_heavy") + h < 3)))
    positive = _named({"ARG": ("NH1", "NH2"), "LYS": ("NZ",), "HIS": ("ND1", "NE2"), "HID": ("ND1", "NE2"), "HIE": ("ND1", "NE2"), "HIP": ("ND1", "NE2")})
    negative = _named({"ASP": ("OD1", "OD2"), "GLU": ("OE1", "OE2")})
    plain = (el == "F") | ((el == "C") & (F.col("n_not_c") == 0))
    return feature.withColumn("atom_type", _bits({
        "HbondDonor": ((el == "N") & (name == "N") & (res != "PRO")) | (el.isin("N", "O", "S") & (h > 0)) | his,
        "HbondAcceptor": (el == "O") | (el == "F") | ((el == "N") & (name == "N")) | his | lone | ((el == "S") & (res.isin("CYS", "MET") | (charge < 0))),
        "PositiveCharge": positive | (free & (el.isin("MG", "MN", "RH", "ZN", "FE", "BI", "AS", "AG") | (charge > 0))),
        "NegativeCharge": negative | (free & (charge < 0)),
        "Hydrophobic": plain & (free | res.isin("ALA", "PHE", "GLY", "ILE", "LEU", "PRO", "VAL", "TRP")),
    }))


def has(column: Column, name: str) -> Column:
    return column.bitwiseAND(F.lit(TYPES[name])) != 0


def type_names(column: Column) -> Column:
    """The names of the set bits, in order."""
    return F.filter(F.array(*[F.when(has(column, n), F.lit(n)) for n in TYPES]), lambda n: n.isNotNull())


def rings(atoms: DataFrame, model: list[str] = MODEL, feature: DataFrame | None = None) -> DataFrame:
    """(model, ring_id, residue, atom_ids, center, normal, x, y, z, aromatic) of the rings of known residues, and with feature of ligands' planar rings."""
    rows = [(r, k, p, n, len(ring)) for r, many in RINGS.items() for k, ring in enumerate(many) for p, n in enumerate(ring)]
    table = F.broadcast(atoms.sparkSession.createDataFrame(rows, "resname string, ring_no int, place int, name string, size int"))  # a fixed table
    met = atoms.where(F.col("resname").isin(*RINGS)).select(*model, *RESIDUE, "atom_id", "name", "altloc", "x", "y", "z").join(table, ["resname", "name"])
    first = Window.partitionBy(*model, *RESIDUE, "ring_no", "place").orderBy("altloc", "atom_id")
    one = met.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    grouped = one.groupBy(*model, *RESIDUE, "ring_no", "size").agg(F.array_sort(F.collect_list(F.struct("place", "atom_id", F.struct("x", "y", "z").alias("p")))).alias("parts"))
    whole = grouped.where(F.size("parts") == F.col("size")).withColumns({"atom_ids": F.col("parts.atom_id"), "points": F.transform("parts", lambda t: t["p"])})
    measured = whole.select(*model, *RESIDUE, "ring_no", "atom_ids", centroid(F.col("points")).alias("center"), ring_normal(F.col("points")).alias("normal"))
    if feature is not None:
        from helixframe.operators.ligands import ligand_rings

        measured = measured.unionByName(ligand_rings(feature, model))
    index = F.row_number().over(Window.partitionBy(*model).orderBy(F.col("atom_ids")[0], "ring_no", "atom_ids")) - 1
    return measured.select(*model, index.cast("long").alias("ring_id"), *RESIDUE, "atom_ids", "center", "normal", "center.x", "center.y", "center.z", F.lit(True).alias("aromatic"))


def charge_groups(feature: DataFrame, model: list[str] = MODEL) -> DataFrame:
    """(model, group_id, residue, kind, feature, atom_ids, points, first_bonds, x, y, z): charged side chains, phosphates, ions, and of ligands
    carboxylates, sulfonates, sulfates, guanidines, acetamidines and the nitrogens that hold a metal.

    first_bonds holds the ids of the atoms bonded to the group's first.
    """
    el, res, name = F.col("el"), F.col("resname"), F.col("name")
    side = ~name.isin("N", "CA", "C", "O", "OXT")
    positive = res.isin("ARG", "HIS", "LYS") & (el == "N") & side
    negative = res.isin("ASP", "GLU") & (el == "O") & side
    phosphate = (el == "O") & (F.col("rclass") != "protein") & F.coalesce(F.exists("nbrs", lambda n: n["element"] == "P"), F.lit(False))
    ion = (F.col("rclass") == "other") & (F.coalesce(F.col("formal_charge"), F.lit(0)) > 0)
    center_of = F.filter("nbrs", lambda n: n["element"].isin("P", "C", "S"))[0]["atom_id"]
    around = lambda e: F.size(F.filter("nbrs", lambda n: n["element"] == e))
    ends_in = F.when(  # what a central atom of a ligand makes of its end atoms
        (el == "C") & (around("O") == 2) & (F.col("n_heavy") == 3) & (F.col("hyb") == 2), "Carboxylate"
    ).when((el == "S") & (around("O") == 3), "Sulfonate").when((el == "S") & (around("O") == 4), "Sulfate").when(
        (el == "C") & (F.col("n_heavy") == 3) & (around("N") == 3), "Guanidine"
    ).when((el == "C") & (F.col("n_heavy") == 3) & (around("N") == 2) & (around("C") == 1) & (F.col("hyb") == 2), "Acetamidine")
    ends_of = F.when(F.col("__feature").isin("Guanidine", "Acetamidine"), "N").otherwise("O")
    centers = feature.where(F.col("rclass") == "other").withColumn("__feature", ends_in).where("__feature is not null")
    ends = centers.select(*model, F.col("atom_id").alias("__center"), "__feature", F.explode("nbrs").alias("n"), ends_of.alias("__end")).where("n.element = __end")
    acids = ends.groupBy(*model, F.col("n.atom_id").alias("atom_id")).agg(F.min_by(F.struct("__center", "__feature"), "__center").alias("__c")).select(*model, "atom_id", "__c.*")
    marked = attach(feature, acids, [*model, "atom_id"])
    metals = feature.where((F.col("rclass") == "other") & el.isin(*METALS_TRANSITION)).select(*model, *RESIDUE).distinct().withColumn("__metal", F.lit(True))
    marked = marked.join(radius.unsent(metals), [*model, *RESIDUE], "left")
    bare = (el == "N") & (F.col("rclass") == "other") & F.col("__metal") & (F.col("n_heavy") == 2) & (F.col("n_h") + F.col("implicit_h") == 0)  # a nitrogen that gave its proton to hold the metal
    bare = F.coalesce(bare, F.lit(False))
    base = F.col("__feature").isin("Guanidine", "Acetamidine")
    kind = F.when(positive | ion | F.coalesce(base, F.lit(False)), "positive").when(negative | phosphate | bare | F.col("__center").isNotNull(), "negative")
    label = F.when(phosphate, "Phosphate").otherwise(F.coalesce("__feature", F.lit("None")))
    part = F.when(phosphate, center_of).when(F.col("__center").isNotNull(), F.col("__center")).when(ion | bare, F.col("atom_id")).otherwise(F.lit(-1))
    rows = marked.withColumns({"kind": kind, "feature": label, "__part": part.cast("long")}).where("kind is not null")
    grouped = rows.groupBy(*model, *RESIDUE, "kind", "feature", "__part").agg(F.array_sort(F.collect_list(F.struct("atom_id", F.struct("x", "y", "z").alias("p"), F.transform("nbrs", lambda n: n["atom_id"]).alias("bonds")))).alias("parts"))
    measured = grouped.withColumns({"first_bonds": F.col("parts")[0]["bonds"], "atom_ids": F.col("parts.atom_id"), "points": F.transform("parts", lambda t: t["p"])}).withColumn("center", centroid(F.col("points")))
    index = F.row_number().over(Window.partitionBy(*model).orderBy(F.col("atom_ids")[0], "kind")) - 1
    return measured.select(*model, index.cast("long").alias("group_id"), *RESIDUE, "kind", "feature", "atom_ids", "points", "first_bonds", "center.x", "center.y", "center.z")
