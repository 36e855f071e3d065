"""Crowded boxes: many points within every radius. Memory and shuffles stay in proportion to the points, results stay whole."""

import math
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from helixframe.operators import contacts, near, radius, topology
from helixframe.operators.kernels import block_width
from helixframe.operators.sasa import areas, measure, sphere
from helixframe.plans import spatial
from helixframe.sources import peptides


def area_by_definition(i, xyz, radii, probe, points):
    grown = radii + probe
    spots = xyz[i] + grown[i] * sphere(points)
    shaded = ((spots[:, None] - np.delete(xyz, i, 0)[None]) ** 2).sum(-1) <= np.delete(grown, i) ** 2
    return 4 * math.pi * grown[i] ** 2 * (points - shaded.any(1).sum()) / points


def test_areas_of_crowded_atoms_in_bounded_memory():
    rng = np.random.default_rng(7)
    xyz = np.concatenate([rng.standard_normal((6000, 3)) * 5, rng.random((300, 3)) * 60 - 30])
    radii = rng.choice([1.2, 1.7, 2.0], len(xyz))
    tracemalloc.start()
    found = areas(xyz, radii, 1.4, 48)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    some = np.r_[0:6000:40, 6000:6300]
    expected = np.array([area_by_definition(i, xyz, radii, 1.4, 48) for i in some])
    assert np.allclose(found[some], expected) and (expected[150:] > 0).sum() > 100
    assert peak < 300e6


def test_coincident_centres_among_crowded_atoms():
    rng = np.random.default_rng(8)
    xyz = rng.standard_normal((3000, 3)) * 4
    xyz[10:13], xyz[20:22], xyz[30:32] = xyz[10], xyz[20], xyz[30]
    ids, altloc = np.arange(3000), np.full(3000, "", dtype=object)
    ids[21], altloc[30], altloc[31], altloc[12] = 20, "A", "B", "C"
    _, same = measure(xyz, np.full(3000, 1.7), np.zeros(3000, dtype=np.int64), np.arange(3000), 1.4, 24, ids, altloc.astype(str))
    assert np.flatnonzero(same).tolist() == [10, 11, 12]


def crowded(spark, n=1500):
    """Typed atoms of all bits in a narrow box, as rings and points too."""
    rng = np.random.default_rng(9)
    rows = [(i, *map(float, rng.standard_normal(3) * 4), str(i % 3), i // 8, "LIG", "C", "", 512 | 16, 3) for i in range(n)]
    return spark.createDataFrame(rows, "atom_id long, x double, y double, z double, chain string, resid int, resname string, el string, altloc string, atom_type int, hyb int")


def rings_of(atoms):
    at = F.struct("x", "y", "z").alias("center")
    normal = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z")).alias("normal")
    return atoms.select(F.col("atom_id").alias("ring_id"), "chain", "resid", "resname", at, normal, F.array("atom_id").alias("atom_ids"), "x", "y", "z")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_crowded_atoms_are_not_shuffled(spark):
    atoms = crowded(spark)
    found = contacts.atom_contacts(atoms, tuple(r for r in contacts.ARPEGGIO if r.type == "Hydrophobic"), [])
    assert plan(found).count("Exchange") == 1 and "Join" not in plan(found)
    p = np.array([(r.x, r.y, r.z, int(r.chain), r.resid) for r in atoms.orderBy("atom_id").collect()])
    close = ((p[:, None, :3] - p[None, :, :3]) ** 2).sum(-1) <= 20.25
    apart = (p[:, None, 3] != p[None, :, 3]) | (np.abs(p[:, None, 4] - p[None, :, 4]) > 1)
    assert {(r.lhs, r.rhs) for r in found.collect()} == set(zip(*np.nonzero(np.triu(close & apart, 1)), strict=True))


def test_pairs_of_crowded_rings_are_not_shuffled_or_joined(spark):
    atoms = crowded(spark)
    rings = rings_of(atoms)
    for found in (contacts.getcontacts_pi_stacking(rings, []), contacts.molstar_pi_stacking(rings, []), contacts.getcontacts_cation_pi(atoms, rings, [])):
        assert plan(found).count("Exchange") == 1 and "Join" not in plan(found)
    p = np.array([(r.x, r.y, r.z, int(r.chain), r.resid) for r in atoms.orderBy("atom_id").collect()])
    v = p[:, None, :3] - p[None, :, :3]
    d2 = (v**2).sum(-1)
    other = (p[:, None, 3] != p[None, :, 3]) | (p[:, None, 4] != p[None, :, 4])
    tilt = np.degrees(np.arccos(np.abs(v[..., 2]) / np.sqrt(np.where(d2 > 0, d2, np.inf))))
    expected = np.triu(other & (d2 <= 49.0) & (tilt <= 45.0), 1)
    stacked = contacts.getcontacts_pi_stacking(rings, []).collect()
    assert {(r.lhs - (1 << 56), r.rhs - (1 << 56)) for r in stacked} == set(zip(*np.nonzero(expected), strict=True)) and {r.type for r in stacked} == {"PiStackingP"}


def test_blocks_of_crowded_points_are_narrow(spark):
    atoms = crowded(spark)
    assert block_width(atoms, [], 4.0, 40.0, 2000) == 40.0 and block_width(atoms, [], 4.0, 40.0, 100) == 4.0


def test_growing_tables_are_not_sent_to_the_driver_because_their_files_are_small(spark, tmp_path):
    rows = [tuple(r.values()) for r in peptides.rows("m", "ACDEFGHIKLMNPQRSTVWY" * 3, (-120.0, 130.0))]
    spark.createDataFrame(rows, peptides.ATOMS).write.parquet(f"file://{tmp_path}/atoms")
    atoms = spark.read.parquet(f"file://{tmp_path}/atoms")
    for df in (topology.bonds(atoms), topology.bonds(atoms, ends=True), topology.features(atoms), topology.features(atoms, topology.bonds(atoms))):
        assert "Broadcast" not in plan(df)
    key = lambda df: sorted((r.a, r.b) for r in df.collect())
    assert key(topology.bonds(atoms)) == key(topology.bonds(atoms, ends=True)) and topology.bonds(atoms).count() > 200


def test_a_nested_loop_takes_any_number_of_points(spark, monkeypatch):
    atoms = crowded(spark, 700)
    monkeypatch.setattr(radius, "BRUTE_POINTS", 500)
    key = lambda df: sorted((r.i, r.j, r.distance_sq) for r in df.collect())
    found = key(radius.nested_loop(atoms, 2.0))
    assert found == key(radius.self_join(atoms, 2.0)) and len(found) > 1000
    monkeypatch.setattr(spatial, "points", lambda *_: atoms)
    assert spatial.brute(spark, "").count() == len(key(radius.self_join(atoms, spatial.RADIUS)))  # this was an error
    assert radius.nested_loop(atoms.limit(0), 2.0).count() == 0


def test_nearest_points_without_all_pairs(spark):
    atoms = crowded(spark, 600).unionByName(crowded(spark, 600).where("atom_id < 40").selectExpr("atom_id + 1000 as atom_id", "x * 20 as x", "y", "z", "chain", "resid", "resname", "el", "altloc", "atom_type", "hyb"))
    df = near.nearest(atoms, 2, 10.0, [])
    assert plan(df).count("Exchange") == 1 and "Window" not in plan(df)
    rows = {r.atom_id: np.array([r.x, r.y, r.z]) for r in atoms.collect()}
    expected = set()
    for i, p in rows.items():
        by = sorted((((p - q) ** 2).sum(), j) for j, q in rows.items() if j != i)[:2]
        expected |= {(i, j, k + 1) for k, (d2, j) in enumerate(by) if d2 <= 100.0}
    assert {(r.i, r.j, r["rank"]) for r in df.collect()} == expected and 1000 < len(expected) < 1280
