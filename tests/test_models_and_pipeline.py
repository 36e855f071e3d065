"""Atoms and bonds of models without files, ligand rings, retyping, the pipeline's report and dependencies."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from helixframe.operators import contacts, ligands, topology
from helixframe.operators.shape import ATOMS as COUNTS
from helixframe.sources import model_atoms as ma
from helixframe.sources import peptides, sinks


def test_templates_are_whole():
    for letter, n in COUNTS.items():
        names = ma.names_of(letter)
        assert len(names) == len(set(names)) == n
        reached, edges = {0}, ma.bonds_of(letter)
        for _ in names:
            reached |= {b for a, b in edges if a in reached} | {a for a, b in edges if b in reached}
        rings = {"P": 1, "F": 1, "Y": 1, "H": 1, "W": 2}.get(letter, 0)
        assert reached == set(range(n)) and len(edges) == n - 1 + rings


def model(spark, sequence="GAGAA"):
    """A peptide of G and A as a model row; a terminal oxygen at the place of its last atom, pushed away."""
    by = {(i, name): p for i, _, name, p in peptides.build(sequence)}
    coords = [by[i, name] for i, letter in enumerate(sequence) for name in ma.names_of(letter)]
    coords.append(coords[-1] + [1.9, 1.2, 0.0])
    return spark.createDataFrame([("m", sequence, [{k: float(v) for k, v in zip("xyz", p, strict=True)} for p in coords]), ("short", "GA", [{"x": 0.0, "y": 0.0, "z": 0.0}])], "model_id string, sequence string, coords array<struct<x: double, y: double, z: double>>")


def test_model_atoms_and_bonds_equal_those_by_distance(spark):
    m = model(spark)
    atoms = ma.model_atoms(m)
    rows = atoms.orderBy("atom_id").collect()
    assert [(r.resid, r.name) for r in rows[:6]] == [(1, "N"), (1, "CA"), (1, "C"), (1, "O"), (2, "N"), (2, "CA")] and rows[-1].name == "OXT" and {r.model_id for r in rows} == {"m"}
    pairs = lambda df: {(min(r.a, r.b), max(r.a, r.b)) for r in df.collect()}
    known = pairs(ma.model_bonds(m))
    oxt = rows[-1].atom_id
    assert {p for p in known if oxt not in p} == {p for p in pairs(topology.bonds(atoms)) if oxt not in p} and sum(oxt in p for p in known) == 1
    key = lambda df: sorted((r.lhs, r.rhs, r.type) for r in df.where(f"lhs <> {oxt} and rhs <> {oxt}").collect())
    assert key(contacts.contacts(atoms, bond=ma.model_bonds(m))) == key(contacts.contacts(atoms, bond=topology.bonds(atoms)))


def test_disulfide_bonds(spark):
    sequence = "CC"
    coords = [{"x": float(k), "y": 10.0 * (k >= 6), "z": 0.0} for k in range(13)]
    coords[5], coords[11] = {"x": 0.0, "y": 5.0, "z": 5.0}, {"x": 0.0, "y": 5.0, "z": 7.05}
    m = spark.createDataFrame([("m", sequence, coords)], "model_id string, sequence string, coords array<struct<x: double, y: double, z: double>>")
    found = {(r.a, r.b) for r in ma.model_bonds(m).collect()}
    assert (5, 11) in found and (2, 6) in found and (8, 12) in found and len(found) == 13


def ring_points(n, radius=1.39, z=0.0, bend=0.0):
    return [(radius * math.cos(2 * math.pi * k / n), radius * math.sin(2 * math.pi * k / n), z + (bend if k % 2 else 0.0)) for k in range(n)]


def ligand(spark, shapes):
    rows = []
    for r, points in enumerate(shapes):
        rows += [("m", 0, len(rows) + k, f"C{k}", "C", "LIG", r + 1, "A", "", 0, x + 30 * r, y, z) for k, (x, y, z) in enumerate(points)]
    return spark.createDataFrame(rows, peptides.ATOMS)


def test_ligand_rings_are_found_once_and_only_planar_ones(spark):
    square_and_five = ring_points(5, 1.2)
    a = ligand(spark, [ring_points(6), ring_points(6, bend=0.6), square_and_five, ring_points(4, 1.05), ring_points(6)[:5]])
    feature = topology.features(a, topology.bonds(a, ends=True))
    found = sorted((r.resid, len(r.atom_ids)) for r in ligands.ligand_rings(feature).collect())
    assert found == [(1, 6), (3, 5)]
    nodes = spark.createDataFrame([("m", i, [j for j in ids]) for i, ids in enumerate([[1, 5], [0, 2, 4], [1, 3], [2, 4], [1, 3, 5], [0, 4]])], "model_id string, atom_id long, ids array<long>")
    assert [r for r in ligands.find_rings(nodes, ["model_id"]).collect()] == []  # two squares side by side: the hexagon around them has a chord
    two = spark.createDataFrame([("m", i, ids) for i, ids in enumerate([[1, 5], [0, 2, 6], [1, 3], [2, 4], [3, 5], [0, 4], [1, 7], [6]])], "model_id string, atom_id long, ids array<long>")
    assert [sorted(r.atom_ids) for r in ligands.find_rings(two, ["model_id"]).collect()] == [[0, 1, 2, 3, 4, 5]]


def test_planarity_and_angles(spark):
    points = lambda p: F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("xyz", q, strict=True)]) for q in p])
    row = spark.range(1).select(ligands.is_planar(points(ring_points(6))).alias("flat"), ligands.is_planar(points(ring_points(6, bend=0.7))).alias("bent"), ligands.smallest_moment(points([(2, 0, 0), (-2, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 0.5), (0, 0, -0.5)])).alias("least")).first()
    assert row.flat and not row.bent and row.least == pytest.approx(0.5)
    rings = spark.createDataFrame([("m", 0, 0, {"x": 0.0, "y": 0.0, "z": 0.0}, {"x": 0.0, "y": 0.0, "z": 2.0})], "model_id string, frame int, ring_id long, center struct<x: double, y: double, z: double>, normal struct<x: double, y: double, z: double>")
    asked = spark.createDataFrame([("m", 0, 0, 0.0, 0.0, 3.0), ("m", 0, 0, 1.0, 0.0, -1.0), ("m", 0, 7, 1.0, 1.0, 1.0)], "model_id string, frame int, ring_id long, x double, y double, z double")
    assert sorted(round(r.angle, 6) for r in ligands.ring_angles(rings, asked).collect()) == [0, 0, 135]
    assert sorted(round(r.angle, 6) for r in ligands.acute_ring_angles(rings, asked).collect()) == [0, 0, 45]


def test_charge_groups_of_ligands(spark):
    c = 1.33
    flat = [(0, 0, 0), (c, 0, 0), (-c / 2, c * 0.866, 0), (-c / 2, -c * 0.866, 0)]
    kinds = {"guanidine": "CNNN", "carboxylate": "COOC", "acetamidine": "CNNC", "sulfonate": "SOOO"}
    rows = []
    for r, elements in enumerate(kinds.values()):
        rows += [("m", 0, len(rows) + k, f"{e}{k}", e, "LIG", r + 1, "A", "", 0, x + 30.0 * r, float(y), float(z)) for k, (e, (x, y, z)) in enumerate(zip(elements, flat, strict=True))]
    a = spark.createDataFrame(rows, peptides.ATOMS)
    found = {r.resid: (r.kind, r.feature, len(r.atom_ids)) for r in topology.charge_groups(topology.features(a, topology.bonds(a, ends=True))).collect()}
    assert found == {1: ("positive", "Guanidine", 3), 2: ("negative", "Carboxylate", 2), 3: ("positive", "Acetamidine", 2), 4: ("negative", "Sulfonate", 3)}


def test_retype(spark):
    a = spark.createDataFrame([tuple(r.values()) for r in peptides.rows("m", "AKDE")], peptides.ATOMS)
    feature = topology.features(a, topology.bonds(a, ends=True))
    types = lambda df: {(r.atom_id, r.atom_type) for r in df.collect()}
    assert types(ligands.retype(topology.molstar_types(feature), "arpeggio")) == types(topology.arpeggio_types(feature))
    with pytest.raises(ValueError, match="molstar"):
        ligands.retype(feature, "none")


def test_pipeline_infers_dependencies_and_reports(spark, tmp_path):
    source = spark.createDataFrame([("a", 1), ("b", 0)], "model_id string, n int")
    p = sinks.Pipeline(source)
    p.add_task("doubled", lambda source: source.withColumn("n", F.col("n") * 2)).add_task("both", lambda source, doubled: source.unionByName(doubled))
    p.add_item_task("inverse", lambda row: {"v": 1 / row["n"]}, requires=("n",))
    with pytest.raises(ValueError, match="no column"):
        p.add_task("bad", lambda df: df, requires=("nothing",))
    p.attach("both", sinks.memory).attach("inverse", sinks.memory).attach("inverse", lambda df: 1 / 0, required=False)
    out = p.run()
    assert len(out["both"][0]) == 4 and out["inverse"][1] is None and "both <- source, doubled" in p.describe()
    report = {(r["channel"], r["error"] is None): r for r in p.report}
    assert report["both", True]["rows"] == 4 and report["inverse", True] | {"seconds": 0} == {"channel": "inverse", "seconds": 0, "error": None, "rows": 2, "failed": 1} and "ZeroDivision" in report["inverse", False]["error"]
    p.attach("both", lambda df: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        p.run()


def test_files_are_written_whole(spark, tmp_path):
    m = model(spark).where("model_id = 'm'")
    assert sinks.write_files(sinks.positions(m, 2), str(tmp_path)) == 1
    path = os.path.join(tmp_path, sinks.positions_path("m", 2))
    assert os.path.getsize(path) == 12 * m.select(F.size("coords")).first()[0]
    assert json.dumps(os.listdir(os.path.dirname(path))) == '["m.bin"]'


def test_mmjson_and_components(spark, tmp_path):
    from helixframe.sources import structures

    site = {"group_PDB": ["ATOM", "HETATM"], "type_symbol": ["N", "O"], "label_atom_id": ["N", "O"], "label_alt_id": [None, None], "label_comp_id": ["ALA", "HOH"], "label_asym_id": ["A", "B"], "label_seq_id": [1, None], "auth_seq_id": [1, 7], "Cartn_x": [1.0, 2.0], "Cartn_y": [0.5, 1.5], "Cartn_z": [0, 3]}
    (tmp_path / "a.json").write_text(json.dumps({"data_X": {"atom_site": site}}))
    component = "data_LIG\nloop_\n_chem_comp_atom.comp_id\n_chem_comp_atom.atom_id\n_chem_comp_atom.type_symbol\n_chem_comp_atom.charge\n_chem_comp_atom.model_Cartn_x\n_chem_comp_atom.model_Cartn_y\n_chem_comp_atom.model_Cartn_z\n_chem_comp_atom.pdbx_model_Cartn_x_ideal\n_chem_comp_atom.pdbx_model_Cartn_y_ideal\n_chem_comp_atom.pdbx_model_Cartn_z_ideal\nLIG C1 C 0 1 2 3 0.1 0.2 0.3\nLIG N1 N 1 4 5 6 ? ? ?\n#\nloop_\n_chem_comp_bond.comp_id\n_chem_comp_bond.atom_id_1\n_chem_comp_bond.atom_id_2\n_chem_comp_bond.value_order\n_chem_comp_bond.pdbx_aromatic_flag\nLIG C1 N1 DOUB N\n#\n"
    (tmp_path / "l.cif").write_text(component)
    found = {os.path.basename(r.model_id): [] for r in structures.read_atoms(spark, str(tmp_path)).collect()}
    for r in structures.read_atoms(spark, str(tmp_path)).collect():
        found[os.path.basename(r.model_id)].append((r.name, r.resname, r.x, r.formal_charge, r.error))
    assert found == {"a.json": [("N", "ALA", 1.0, 0, None), ("O", "HOH", 2.0, 0, None)], "l.cif": [("C1", "LIG", 0.1, 0, None), ("N1", "LIG", 4.0, 1, None)]}
    assert structures.component_bonds(component) == [{"a": 0, "b": 1, "order": 2, "aromatic": False}]


def test_stream_delivery_with_optional_sinks(spark, tmp_path):
    from helixframe.streaming import streams

    spark.range(5).write.parquet(f"{tmp_path}/in")
    got, failures = [], []
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    assert streams.deliver(stream, [(lambda b, n: got.append(b.count()), True), (lambda b, n: 1 / 0, False)], f"{tmp_path}/check", 120, failures)
    assert sum(got) == 5 and all("ZeroDivision" in f for _, f in failures) and failures


def test_options_text_and_decoding(spark, tmp_path):
    m = model(spark).where("model_id = 'm'")
    found = sinks.Options(models=True).contacts(m)
    assert found.count() == sinks.Options().contacts(ma.model_atoms(m)).count()
    for bad in (lambda: sinks.Options(typing="none"), lambda: sinks.Options(topology=False).contacts(m)):
        with pytest.raises(ValueError):
            bad()
    rows = spark.createDataFrame([("m", 0, 1, 2, "Ionic", 4.0)], "model_id string, frame int, lhs long, rhs long, type string, distance_sq double")
    sinks.contact_rows(rows).write.text(f"{tmp_path}/c.ndjson")
    rows.write.parquet(f"{tmp_path}/c")
    assert sinks.decode_contacts(spark, f"{tmp_path}/c.ndjson").collect() == sinks.decode_contacts(spark, [f"{tmp_path}/c"]).collect() == rows.collect()
    labelled = rows.withColumns({"label_l": F.lit("1-N"), "label_r": F.lit("2-O")})
    assert sinks.contact_text(labelled).first().payload == "1-N 2-O Ionic 2.0000"


def test_accessibility_sums_areas_of_residues(spark):
    from helixframe.operators.sasa import accessibility

    a = spark.createDataFrame([tuple(r.values()) for r in peptides.rows("m", "AGA")], peptides.ATOMS)
    found = {r.resid: r.accessibility for r in accessibility(a, 64).collect()}
    assert set(found) == {1, 2, 3} and min(found.values()) > 20 and found[2] < max(found[1], found[3])
