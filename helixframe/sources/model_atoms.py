"""Atoms and bonds of predicted models from their sequences and coordinates: no file and no bond search is needed.

A model's coordinates stand in the order of its residues' templates, so atoms, names and bonds follow from the sequence
by array expressions on the model's row; nothing is shuffled. Only disulfide bonds depend on distances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.geometry import distance_sq
from helixframe.operators.shape import ATOMS as COUNTS
from helixframe.operators.shape import atom_counts, prefix_sums
from helixframe.sources.models import ONE

DISULFIDE = 2.5
# Side-chain atoms of the standard residues in the order of predicted models, after N, CA, C, CB and O.
SIDE = {
    "A": "", "R": "CG CD NE NH1 NH2 CZ", "N": "CG ND2 OD1", "D": "CG OD1 OD2", "C": "SG", "Q": "CG CD NE2 OE1", "E": "CG CD OE1 OE2", "H": "CG CD2 ND1 CE1 NE2", "I": "CG1 CG2 CD1",
    "L": "CG CD1 CD2", "K": "CG CD CE NZ", "M": "CG SD CE", "F": "CG CD1 CD2 CE1 CE2 CZ", "P": "CG CD", "S": "OG", "T": "CG2 OG1", "W": "CG CD1 CD2 CE2 CE3 NE1 CH2 CZ2 CZ3", "Y": "CG CD1 CD2 CE1 CE2 OH CZ", "V": "CG1 CG2",
}
# Bonds of the side chains beyond CB.
BONDS = {
    "R": "CB-CG CG-CD CD-NE NE-CZ CZ-NH1 CZ-NH2", "N": "CB-CG CG-OD1 CG-ND2", "D": "CB-CG CG-OD1 CG-OD2", "C": "CB-SG", "Q": "CB-CG CG-CD CD-OE1 CD-NE2", "E": "CB-CG CG-CD CD-OE1 CD-OE2",
    "H": "CB-CG CG-ND1 CG-CD2 ND1-CE1 CD2-NE2 CE1-NE2", "I": "CB-CG1 CB-CG2 CG1-CD1", "L": "CB-CG CG-CD1 CG-CD2", "K": "CB-CG CG-CD CD-CE CE-NZ", "M": "CB-CG CG-SD SD-CE",
    "F": "CB-CG CG-CD1 CG-CD2 CD1-CE1 CD2-CE2 CE1-CZ CE2-CZ", "P": "CB-CG CG-CD CD-N", "S": "CB-OG", "T": "CB-OG1 CB-CG2",
    "W": "CB-CG CG-CD1 CG-CD2 CD1-NE1 NE1-CE2 CD2-CE2 CD2-CE3 CE2-CZ2 CE3-CZ3 CZ2-CH2 CZ3-CH2", "Y": "CB-CG CG-CD1 CG-CD2 CD1-CE1 CD2-CE2 CE1-CZ CE2-CZ CZ-OH", "V": "CB-CG1 CB-CG2",
}
THREE = {one: three for three, one in ONE.items()}


def names_of(letter: str) -> list[str]:
    return ["N", "CA", "C", *([] if letter == "G" else ["CB"]), "O", *SIDE.get(letter, "").split()]


def bonds_of(letter: str) -> list[tuple[int, int]]:
    """Bonds of a residue as places in its template."""
    pairs = "N-CA CA-C C-O " + ("" if letter == "G" else "CA-CB ") + BONDS.get(letter, "")
    at = names_of(letter).index
    return [tuple(sorted(map(at, p.split("-")))) for p in pairs.split()]


def _by_letter(values: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def _letters() -> Column:
    return F.filter(F.split("sequence", ""), lambda c: c != "")


def complete(models: DataFrame) -> DataFrame:
    """The models whose coordinates fit their sequence."""
    return models.where(F.aggregate(atom_counts(F.col("sequence")), F.lit(0), lambda a, n: a + n) == F.size("coords"))


def model_atoms(models: DataFrame) -> DataFrame:
    """Atoms of models (model_id, sequence, coords) as `read_atoms` gives them: one chain A, frame 0."""
    names = _by_letter({k: F.array(*map(F.lit, names_of(k))) for k in COUNTS})
    three = _by_letter({k: F.lit(THREE[k]) for k in COUNTS})
    letters = _letters()
    of_residue = lambda c, i: F.transform(F.concat(F.element_at(names, c), F.when(i == F.size(letters) - 1, F.array(F.lit("OXT"))).otherwise(F.array().cast("array<string>"))), lambda n: F.struct((i + 1).alias("resid"), F.element_at(three, c).alias("resname"), n.alias("name")))
    zipped = F.arrays_zip(F.flatten(F.transform(letters, of_residue)).alias("r"), F.col("coords").alias("p"))
    rows = complete(models).select("model_id", F.posexplode(zipped).alias("atom_id", "a"))
    return rows.select(
        "model_id", F.lit(0).alias("frame"), F.col("atom_id").cast("long").alias("atom_id"), F.substring("a.r.name", 1, 1).alias("element"), "a.r.name", "a.r.resname", F.col("a.r.resid").cast("int").alias("resid"), F.lit("A").alias("chain"), F.lit("").alias("altloc"),
        F.lit(0).alias("formal_charge"), "a.p.x", "a.p.y", "a.p.z",
    )


def model_bonds(models: DataFrame) -> DataFrame:
    """(model_id, frame, a, b) from templates: within residues, along the chain, at the terminal oxygen, and disulfides by distance."""
    pairs = _by_letter({k: F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in bonds_of(k)]) for k in COUNTS})
    based = complete(models).select("model_id", _letters().alias("letters"), "coords", prefix_sums(atom_counts(F.col("sequence"))).alias("starts"))
    start = lambda i: F.get(F.col("starts"), i)
    bond = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    n = F.size("letters")
    inside = F.flatten(F.transform("letters", lambda c, i: F.transform(F.element_at(pairs, c), lambda p: bond(start(i) + p["a"], start(i) + p["b"]))))
    along = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: bond(start(i) + 2, start(i + 1)))).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))
    end = F.array(bond(start(n - 1) + 2, start(n) - 1))
    sulfurs = F.filter(F.transform("letters", lambda c, i: F.when(c == "C", (start(i) + 5).cast("long"))), lambda s: s.isNotNull())
    place = lambda s: F.get(F.col("coords"), s.cast("int"))
    bridges = F.flatten(F.transform(sulfurs, lambda s: F.transform(F.filter(sulfurs, lambda t: (t > s) & (distance_sq(place(s), place(t)) <= DISULFIDE**2)), lambda t: bond(s, t))))
    each = based.select("model_id", F.explode(F.concat(inside, along, end, bridges)).alias("e"))
    return each.select("model_id", F.lit(0).alias("frame"), "e.a", "e.b")
