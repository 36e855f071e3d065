"""Areas and secondary structure over frames, blocks, alternates and broken structures; radius joins in all cubes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import radius, topology
from helixframe.operators.dssp import dssp
from helixframe.operators.kernels import Grid
from helixframe.operators.sasa import areas, atom_label, element_radius, sasa, united_radius
from helixframe.sources import peptides

ATOMS = "model_id string, frame int, atom_id long, element string, altloc string, x double, y double, z double"


def brute(xyz, radii, probe, points):
    """The definition: a spot is free if it lies in no other atom's grown sphere."""
    from helixframe.operators.sasa import sphere

    grown = radii + probe
    out = []
    for i in range(len(xyz)):
        spots = xyz[i] + grown[i] * sphere(points)
        d2 = ((spots[:, None] - xyz[None]) ** 2).sum(-1)
        shaded = (np.delete(d2, i, 1) <= np.delete(grown, i) ** 2).any(1)
        out.append(4 * math.pi * grown[i] ** 2 * (points - shaded.sum()) / points)
    return np.array(out)


def test_areas_like_the_definition():
    rng = np.random.default_rng(3)
    xyz, radii = rng.random((150, 3)) * 14, rng.choice([1.2, 1.7, 2.0], 150)
    assert np.allclose(areas(xyz, radii, 1.4, 61), brute(xyz, radii, 1.4, 61))


def test_areas_of_a_wide_structure_in_blocks(spark):
    rng = np.random.default_rng(4)
    xyz = rng.random((900, 3)) * np.array([210.0, 30, 30]) - 60
    df = spark.createDataFrame([("m", 0, i, "C", "", *map(float, p)) for i, p in enumerate(xyz)], ATOMS)
    found = {r.atom_id: r.area for r in sasa(df.repartition(5), points=40, decimals=None).collect()}
    assert len(found) == 900 and np.allclose([found[i] for i in range(900)], brute(xyz, np.full(900, 1.7), 1.4, 40))


def test_areas_tell_frames_alternates_and_coincident_atoms_apart(spark):
    rows = [("m", 0, 0, "C", "", 0.0, 0, 0), ("m", 1, 0, "C", "", 0.5, 0, 0), ("m", 1, 1, "C", "", 1.5, 0, 0), ("a", 0, 0, "C", "A", 0.0, 0, 0), ("a", 0, 1, "C", "B", 0.0, 0, 0), ("b", 0, 0, "C", "", 5.0, 0, 0), ("b", 0, 1, "C", "", 5.0, 0, 0), ("b", 0, 2, "C", "", 50.0, 0, 0)]
    df = spark.createDataFrame([(*r[:5], *map(float, r[5:])) for r in rows], ATOMS)
    found = {(r.model_id, r.frame, r.atom_id): (r.area, r.error) for r in sasa(df).collect()}
    whole = round(4 * math.pi * 3.1**2, 3)
    assert found["m", 0, 0] == (whole, None) and found["m", 1, 0][0] < whole and found["a", 0, 0] == found["a", 0, 1] == (whole, None)
    assert found["b", 0, 0][0] is None and "centre" in found["b", 0, 1][1] and found["b", 0, 2] == (whole, None)
    assert sasa(df.limit(0)).count() == 0


def test_united_radii_and_labels(spark):
    rows = [(0, "PHE", "CG", 1), (1, "PHE", "CD1", 1), (2, "ALA", "CB", 2), (3, "SER", "OG", 3), (4, "ASP", "OD1", 4), (5, "ASP", "OD2", 4), (6, "MET", "SD", 5), (7, "TRP", "CD2", 6), (8, "LEU", "CD2", 7), (9, "HEM", "FE", 8), (10, "GLY", "OXT", 9), (11, "ARG", "NH1", 10)]
    df = spark.createDataFrame(rows, "atom_id long, resname string, name string, resid int").withColumn("chain", F.lit("A"))
    found = df.select("atom_id", united_radius().alias("r"), atom_label().alias("l"), element_radius("name").alias("e")).orderBy("atom_id").collect()
    assert [r.r for r in found] == [1.61, 1.76, 1.88, 1.46, 1.42, 1.46, 1.77, 1.61, 1.88, None, 1.46, 1.64]
    assert found[3].l == "3-OG-3-SER-A"


def test_states_of_frames_and_file_order(spark):
    helix, strand = peptides.rows("m", "A" * 14), peptides.rows("m", "A" * 14, (-75.0, 145.0))
    rows = [tuple(r.values()) for r in helix] + [tuple((r | {"frame": 1}).values()) for r in strand]
    second = [tuple((r | {"chain": "0", "atom_id": r["atom_id"] + 1000, "x": r["x"] + 100}).values()) for r in helix]
    found = dssp(spark.createDataFrame(rows + second, peptides.ATOMS).repartition(7)).collect()
    states = {(r.frame, r.chain, r.resid): r.state for r in found}
    assert len(found) == 42 and all(states[0, c, i] == "H" for c in "A0" for i in range(3, 12)) and all(states[1, "A", i] == "P" for i in range(3, 13))
    in_frame = [r.chain for r in found if r.frame == 0]
    assert in_frame == ["A"] * 14 + ["0"] * 14


def test_states_keep_insertions_and_first_alternates(spark):
    rows = peptides.rows("m", "A" * 12)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], peptides.ATOMS).withColumn("insertion", F.when(F.col("resid") == 6, "A").otherwise(""))
    df = df.withColumn("resid", F.when(F.col("resid") == 6, 5).otherwise(F.col("resid")).cast("int"))
    moved = df.where("name = 'CA' and resid = 4").withColumns({"x": F.col("x") + 40, "atom_id": F.col("atom_id") + 5000})
    found = dssp(df.unionByName(moved)).collect()
    assert len(found) == 12 and [(r.resid, r.insertion) for r in found][4:6] == [(5, ""), (5, "A")]


def test_grid_pairs_like_brute_force():
    rng = np.random.default_rng(5)
    xyz, group = rng.random((400, 3)) * 20 - 10, np.sort(rng.integers(0, 3, 400))
    i, j, _ = Grid(xyz, group, 4.0).pairs(np.arange(0, 400, 2))
    near = (((xyz[:, None] - xyz[None]) ** 2).sum(-1) <= 16.0) & (group[:, None] == group[None]) & ~np.eye(400, dtype=bool)
    assert set(zip((i * 2).tolist(), j.tolist(), strict=True)) == {(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a % 2 == 0}


def test_self_join_meets_every_pair_once(spark):
    rng = np.random.default_rng(6)
    xyz = rng.random((300, 3)) * 30 - 15
    df = spark.createDataFrame([("m", i, *map(float, p)) for i, p in enumerate(xyz)], "model_id string, atom_id long, x double, y double, z double")
    found = [(r.i, r.j, r.x_i, r.x_j) for r in radius.self_join(df, 5.0, ["model_id"], keep=["x"]).collect()]
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(-1)
    assert sorted(found) == sorted((int(a), int(b), xyz[a, 0], xyz[b, 0]) for a, b in zip(*np.nonzero(np.triu(d2 <= 25.0, 1)), strict=True))
    with pytest.raises(ValueError, match="self_join"):
        radius.brute_force(spark.range(radius.BRUTE_POINTS + 1).select(F.col("id").alias("atom_id"), *[F.lit(0.0).alias(c) for c in "xyz"]), 1.0)


def test_explicit_hydrogens_count_in_their_scope(spark):
    a = spark.createDataFrame([tuple(r.values()) for r in peptides.rows("m", "AAA")], peptides.ATOMS)
    with_h = a.unionByName(a.where("atom_id = 0").withColumns({"name": F.lit("H"), "element": F.lit("H"), "atom_id": F.lit(99).cast("long"), "x": F.col("x") - 0.9}))
    other = a.withColumn("chain", F.lit("B")).withColumns({"atom_id": F.col("atom_id") + 200, "z": F.col("z") + 50})
    both = with_h.unionByName(other)
    found = topology.features(both, topology.bonds(both, ends=True)).where("name = 'N'").collect()
    assert {(r.chain, r.implicit_h > 0) for r in found} == {("A", False), ("B", True)}


def test_near_atoms_equal_the_join(spark):
    rows = [tuple((r | {"altloc": "A" if r["atom_id"] % 11 == 3 else "B" if r["atom_id"] % 11 == 4 else "", "element": "H" if r["atom_id"] % 7 == 5 else "Zn" if r["atom_id"] == 8 else r["element"]}).values()) for r in peptides.rows("m", "ACDEFGHIKLMNPQRSTVWY" * 6, (-120.0, 130.0))]
    a = spark.createDataFrame(rows, peptides.ATOMS).repartition(5)
    key = lambda df: sorted((r.atom_id, [tuple(n) for n in r.nbrs]) for r in df.collect())
    expected = key(topology.neighbours(a, topology.bonds(a, ends=True)))
    assert key(topology.near_atoms(a)) == expected == key(topology.neighbours(a, topology.bonds(a))) and len(expected) > 400
