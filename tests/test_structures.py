"""Geometry, kernels, contacts, files and pipeline on built structures with known answers."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import geometry as g
from helixframe.functions import interactions as it
from helixframe.functions.selection import SelectionError, parse, selection, tokenize
from helixframe.operators import contact_set, contacts, distances, radius, shape, topology
from helixframe.operators.dssp import dssp
from helixframe.operators.quality_metrics import parse_groups
from helixframe.operators.sasa import areas
from helixframe.sources import models as model_source
from helixframe.sources import peptides, sinks, structures


def frame(spark, xyz, **more):
    rows = [(i, *map(float, p)) for i, p in enumerate(xyz)]
    df = spark.createDataFrame(rows, "atom_id long, x double, y double, z double").withColumn("model_id", F.lit("m"))
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


@pytest.mark.parametrize("kind", ["random", "line", "same", "mixed", "shifted"])
def test_radius_join_equals_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    xyz = {"random": rng.normal(0, 8, (150, 3)), "line": np.stack([np.arange(80) * 0.5, np.zeros(80), np.zeros(80)], 1), "same": np.ones((12, 3)), "mixed": np.concatenate([rng.normal(0, 1, (40, 3)), rng.normal(1e4, 1, (40, 3))]), "shifted": rng.normal(-1e6, 5, (100, 3))}[kind]
    df = frame(spark, xyz)
    found = {(r.i, r.j) for r in radius.self_join(df, 3.0, ["model_id"]).collect()}
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    assert found == {(i, j) for i in range(len(xyz)) for j in range(i + 1, len(xyz)) if d[i, j] <= 3.0}
    cross = {(r.i, r.j) for r in radius.cross_join(df.where("atom_id % 2 = 0"), df, 3.0).collect()}
    assert cross == {(i, j) for i in range(0, len(xyz), 2) for j in range(len(xyz)) if d[i, j] <= 3.0}


def test_radius_edges(spark):
    df = frame(spark, [(0, 0, 0), (3, 0, 0)])
    assert radius.self_join(df, 3.0).count() == 1  # inclusive
    assert radius.self_join(df.limit(0), 3.0).count() == 0
    for bad in (0.0, -1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            radius.self_join(df, bad)


def test_scalars(spark):
    v = lambda *p: g.vec(*map(F.lit, map(float, p)))
    row = spark.range(1).select(
        g.angle(v(1, 0, 0), v(0, 0, 0), v(0, 1, 0)).alias("right"), g.dihedral(v(1, 0, 0), v(0, 0, 0), v(0, 0, 1), v(0, 1, 1)).alias("torsion"), g.vector_angle(v(0, 0, 0), v(1, 0, 0)).alias("none"),
        g.plane_offset(v(3, 4, 9), v(0, 0, 0), v(0, 0, 2)).alias("offset"), g.acute(F.lit(150.0)).alias("acute"),
    ).first()
    assert row.right == pytest.approx(90) and abs(row.torsion) == pytest.approx(90) and row.none is None and row.offset == pytest.approx(5) and row.acute == pytest.approx(30)


def test_selection_language(spark):
    df = spark.createDataFrame([(i, n) for i in range(-3, 12) for n in ("ALA", "GLY")], "resid int, resname string")
    pick = lambda text, **k: {(r.resid, r.resname) for r in df.where(selection(text, **k)).collect()}
    rows = {(r.resid, r.resname) for r in df.collect()}
    assert pick("resid 4-6 and not resname ALA") == {(i, "GLY") for i in (4, 5, 6)}
    assert pick("resid -2 - 1 or resname GLY and resid 9") == {(i, n) for i, n in rows if -2 <= i <= 1 or (n == "GLY" and i == 9)}
    assert pick("not (resid 1 2 5-7 or resname GLY)") == {(i, n) for i, n in rows if not (i in (1, 2, 5, 6, 7) or n == "GLY")}
    assert tokenize("resid 4-10") == ["resid", "4", "-", "10"]
    for bad in ("", "resid", "resid x", "chain A", "resid 1 )", "(resid 1", "resname A - B", "resid 1 and", "resid 3 $"):
        with pytest.raises(SelectionError):
            parse(bad)
    assert pick("resid 3 )", compat=True) == {(3, "ALA"), (3, "GLY")} and pick("bad", compat=True) == set()


def test_interaction_types(spark):
    assert it.code("PiStackingT") == 12 | 2 << 16 and it.parse_type("weak_H-bond") == "WeakHydrogenBond" and it.parse_type("x") is None
    assert "PiStackingP" not in it.TypeSet.of("PiStacking") and "Ionic" in it.TypeSet.of("All") and it.TypeSet.parse("hbond, nope") is None
    assert len(it.PUBLIC) == 19 and all(it.from_short(s) == n for n, s in it.SHORT.items())
    row = spark.range(1).select(it.compact_number(F.lit(3.1)).alias("a"), it.compact_number(F.lit(7.0)).alias("b"), it.compact_number(F.lit(0.126)).alias("c")).first()
    assert tuple(row) == ("3.1", "7", "0.13")


def test_contact_set_laws(spark):
    def made(seed):
        rng = np.random.default_rng(seed)
        keys = sorted({(int(a), int(b), t) for a, b, t in zip(rng.integers(0, 8, 60), rng.integers(8, 16, 60), rng.choice(["Ionic", "Hydrophobic"], 60), strict=True)})
        return spark.createDataFrame([(a, b, t, seed + 0.5) for a, b, t in keys], "lhs long, rhs long, type string, distance_sq double"), {k for k in keys}

    (a, ka), (b, kb) = made(1), made(2)
    keys = lambda df: sorted((r.lhs, r.rhs, r.type) for r in df.collect())
    assert keys(contact_set.union(a, b)) == sorted(ka | kb) and keys(contact_set.intersection(a, b)) == sorted(ka & kb)
    assert keys(contact_set.difference(a, b)) == sorted(ka - kb) and keys(contact_set.symmetric_difference(a, b)) == sorted(ka ^ kb)
    assert all(r.distance_sq == 1.5 for r in contact_set.union(a, b).collect() if (r.lhs, r.rhs, r.type) in ka)
    assert contact_set.insert(a, a).count() == 2 * len(ka)
    assert keys(contact_set.make_generic(contact_set.insert(a, b))) == sorted({(x, y, "Generic") for x, y, _ in ka | kb})


def test_sasa_analytic():
    r, p = 2.0, 0.5
    one = areas(np.zeros((1, 3)), np.array([r]), p, 256)
    assert one[0] == pytest.approx(4 * math.pi * 2.5**2)
    two = areas(np.array([[0, 0, 0], [3.0, 0, 0]]), np.array([r, r]), p, 4096)
    cap = 2 * math.pi * 2.5 * (2.5 - 1.5)
    assert two == pytest.approx([4 * math.pi * 2.5**2 - cap] * 2, rel=0.01)
    assert areas(np.array([[0, 0, 0], [0.1, 0, 0]]), np.array([5.0, 1.0]))[1] == 0
    assert areas(np.array([[0, 0, 0], [50, 0, 0]]), np.array([-1.0, np.nan])).tolist() == [0, 0]
    for bad in ((-1, 10), (float("nan"), 10), (1.4, 0)):
        with pytest.raises(ValueError):
            areas(np.zeros((1, 3)), np.ones(1), *bad)
    with pytest.raises(ValueError):
        areas(np.zeros((2, 3)), np.ones(2))
    assert (areas(np.zeros((2, 3)), np.ones(2), ids=np.array([7, 7])) > 0).all()


def peptide(spark, sequence, torsions=peptides.HELIX, name="m"):
    return spark.createDataFrame([tuple(r.values()) for r in peptides.rows(name, sequence, torsions)], peptides.ATOMS)


def test_ideal_helix_and_extended_chain(spark):
    states = {r.resid: r.state for r in dssp(peptide(spark, "A" * 20)).collect()}
    assert len(states) == 20 and all(states[i] == "H" for i in range(3, 18))
    flat = {r.resid: r.state for r in dssp(peptide(spark, "A" * 12, (-75.0, 145.0))).collect()}
    assert all(flat[i] == "P" for i in range(3, 11))


def test_rotation_and_translation_change_nothing(spark):
    a = peptide(spark, "ACDEFGHIKLMNPQRSTVWY")
    t = math.radians(40)
    moved = a.withColumns({"x": F.col("x") * math.cos(t) - F.col("y") * math.sin(t) + 11, "y": F.col("x") * math.sin(t) + F.col("y") * math.cos(t) - 7, "z": F.col("z") + 100})
    key = lambda df: sorted((r.lhs, r.rhs, r.type) for r in contacts.contacts(df, "molstar").collect())
    assert key(a) == key(moved)
    rg = lambda df: shape.radius_of_gyration(df, ["model_id"]).first().rg
    assert rg(a) == pytest.approx(rg(moved), abs=1e-9)


def test_helix_hydrogen_bonds(spark):
    a = peptide(spark, "A" * 12)
    found = contact_set.resolve(contacts.contacts(a, "molstar", it.TypeSet.parse("hbond")), a)
    pairs = {tuple(sorted(((r.resid_l, r.name_l), (r.resid_r, r.name_r)))) for r in found.collect()}
    assert all(((i, "O"), (i + 4, "N")) in pairs for i in range(1, 8))
    assert all(abs(a[0] - b[0]) >= 3 for a, b in pairs)


def test_bonds_of_a_peptide_are_a_tree(spark):
    a = peptide(spark, "AGPVK")
    assert topology.bonds(a).count() == a.count() - 1
    assert topology.residues(a).orderBy("res_idx").select("resname").toPandas()["resname"].tolist() == ["ALA", "GLY", "PRO", "VAL", "LYS"]


def ring(center, normal, resid, resname="PHE", start=0):
    u = np.cross(normal, [0.3, 0.5, 0.8])
    u = u / np.linalg.norm(u)
    w = np.cross(normal, u)
    names = ("CG", "CD1", "CE1", "CZ", "CE2", "CD2")
    return [(start + k, n, "C", resname, resid, *(np.array(center) + 1.39 * (math.cos(k * math.pi / 3) * u + math.sin(k * math.pi / 3) * w))) for k, n in enumerate(names)]


def typed_atoms(spark, rows):
    df = spark.createDataFrame([(i, n, e, r, int(q), float(x), float(y), float(z)) for i, n, e, r, q, x, y, z in rows], "atom_id long, name string, element string, resname string, resid int, x double, y double, z double")
    return df.withColumns({"model_id": F.lit("m"), "frame": F.lit(0), "chain": F.lit("A"), "altloc": F.lit(""), "formal_charge": F.lit(0)})


@pytest.mark.parametrize(("normal", "shift", "kind"), [((0, 0, 1), (0, 0, 3.8), "PiStackingP"), ((1, 0, 0), (0, 0, 5.0), "PiStackingT"), ((0, 0, 1), (0, 0, 5.6), None), ((0, 0, 1), (4.9, 0, 2.0), None)])
def test_ring_stacking(spark, normal, shift, kind):
    rows = ring((0, 0, 0), (0, 0, 1), 1) + ring(shift, normal, 9, start=6)
    found = [r.type for r in contacts.contacts(typed_atoms(spark, rows), "molstar", it.TypeSet.parse("pistacking")).collect()]
    assert found == ([kind] if kind else [])


@pytest.mark.parametrize(("provider", "names", "gap", "expected"), [
    ("molstar", ("LYS:NZ:N", "ASP:OD1:O"), 3.9, {"Ionic", "HydrogenBond"} - {"HydrogenBond"}),
    ("molstar", ("LYS:NZ:N", "ASP:OD1:O"), 5.1, set()),
    ("molstar", ("VAL:CG1:C", "LEU:CD1:C"), 3.9, {"Hydrophobic"}),
    ("molstar", ("VAL:CG1:C", "LEU:CD1:C"), 4.1, set()),
    ("molstar", ("ZN:ZN:ZN", "HIS:NE2:N"), 2.9, {"MetalCoordination"}),
    ("molstar", ("ZN:ZN:ZN", "HIS:NE2:N"), 3.1, set()),
    ("arpeggio", ("LYS:NZ:N", "ASP:OD1:O"), 3.9, {"Ionic"}),
    ("arpeggio", ("LYS:NZ:N", "ASP:OD1:O"), 3.4, {"Ionic", "PolarHydrogenBond"}),
    ("arpeggio", ("VAL:CG1:C", "LEU:CD1:C"), 4.4, {"Hydrophobic"}),
    ("arpeggio", ("VAL:CG1:C", "LEU:CD1:C"), 3.45, {"Hydrophobic", "VanDerWaals"}),
    ("arpeggio", ("ALA:C:C", "GLY:O:O"), 3.5, {"Carbonyl"}),
    ("arpeggio", ("ALA:C:C", "GLY:O:O"), 3.7, set()),
    ("getcontacts", ("LYS:NZ:N", "ASP:OD1:O"), 3.9, {"Ionic"}),
    ("getcontacts", ("LYS:NZ:N", "ASP:OD1:O"), 3.3, {"Ionic", "HydrogenBond", "VanDerWaals"}),
    ("getcontacts", ("VAL:CG1:C", "LEU:CD1:C"), 3.8, {"Hydrophobic", "VanDerWaals"}),
    ("getcontacts", ("VAL:CG1:C", "LEU:CD1:C"), 3.95, set()),
])
def test_atom_rules_inside_and_outside(spark, provider, names, gap, expected):
    rows = [(k, n.split(":")[1], n.split(":")[2], n.split(":")[0], 1 + 8 * k, gap * k, 0, 0) for k, n in enumerate(names)]
    assert {r.type for r in contacts.contacts(typed_atoms(spark, rows), provider).collect()} >= expected
    if not expected:
        assert contacts.contacts(typed_atoms(spark, rows), provider).count() == 0


def test_cation_pi(spark):
    base = ring((0, 0, 0), (0, 0, 1), 1)
    for provider, z, n in (("molstar", 5.0, 1), ("molstar", 6.2, 0), ("arpeggio", 4.4, 1), ("arpeggio", 4.6, 0), ("getcontacts", 5.9, 1), ("getcontacts", 6.1, 0)):
        rows = [*base, (6, "NZ", "N", "LYS", 20, 0, 0, z)]
        assert contacts.contacts(typed_atoms(spark, rows), provider, it.TypeSet.parse("cationpi")).count() == n, (provider, z)


CIF = """data_x
_struct_ref.pdbx_seq_one_letter_code
;AG
;
_ma_target_ref_db_details.organism_scientific 'Homo sapiens'
_ma_target_ref_db_details.ncbi_taxonomy_id 9606
loop_
_struct_conf.conf_type_id
_struct_conf.beg_label_seq_id
_struct_conf.end_label_seq_id
HELX_RH_AL_P 1 1
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
_atom_site.B_iso_or_equiv
_atom_site.auth_seq_id
_atom_site.auth_asym_id
_atom_site.pdbx_PDB_model_num
ATOM 1 N N . ALA A 1 1.0 2.0 3.0 1.0 95.5 11 B 1
ATOM 2 C CA . ALA A 1 2.0 2.0 3.0 1.0 95.5 11 B 1
ATOM 3 N N . GLY A 2 3.0 2.0 3.0 1.0 40.0 12 B 1
HETATM 4 ZN ZN . ZN C . 9.0 2.0 3.0 1.0 40.0 99 C 1
ATOM 1 N N . ALA A 1 1.5 2.0 3.0 1.0 95.5 11 B 2
ATOM 2 C CA . ALA A 1 2.5 2.0 3.0 1.0 95.5 11 B 2
ATOM 3 N N . GLY A 2 3.5 2.0 3.0 1.0 40.0 12 B 2
HETATM 4 ZN ZN . ZN C . 9.5 2.0 3.0 1.0 40.0 99 C 2
"""
GRO = "title\n2\n    1ALA      N    1   0.100   0.200   0.300\n    2SOL     OW    2   1.000   1.100  -1.200\n   1.0 1.0 1.0\n"
PDB = "ATOM      1  N   ALA A   1       1.000   2.000   3.000  1.00 95.00           N  \nHETATM    2 ZN    ZN A   9       4.000   5.000   6.000  1.00 10.00          ZN2+\nENDMDL\nATOM      1  N   ALA A   1       9.000   2.000   3.000  1.00 95.00           N  \n"


def test_structure_files(spark, tmp_path):
    import gzip

    (tmp_path / "a.cif").write_text(CIF)
    (tmp_path / "b.gro").write_text(GRO)
    (tmp_path / "c.pdb.gz").write_bytes(gzip.compress(PDB.encode()))
    (tmp_path / "d.pdb").write_text("nothing here")
    (tmp_path / "e.txt").write_text("ignored")
    atoms = structures.read_atoms(spark, str(tmp_path), [".cif", ".gro", ".pdb", ".pdb.gz"])
    rows = {}
    for r in atoms.collect():
        rows.setdefault(r.model_id.rsplit("/", 1)[1], []).append(r)
    assert set(rows) == {"a.cif", "b.gro", "c.pdb.gz", "d.pdb"}
    a = sorted(rows["a.cif"], key=lambda r: (r.frame, r.atom_id))
    assert len(a) == 8 and (a[0].chain, a[0].resid, a[0].auth_resid, a[0].name) == ("B", 1, 11, "N") and a[3].resid == 99 and a[3].is_het and a[5].x == 2.5
    assert [(r.x, r.element, r.is_het) for r in rows["b.gro"]] == [(pytest.approx(1.0), "N", False), (pytest.approx(10.0), "O", True)]
    assert [(r.element, r.formal_charge) for r in rows["c.pdb.gz"]] == [("N", 0), ("Zn", 2)]
    assert "ValueError" in rows["d.pdb"][0].error
    frames = structures.frames(atoms.where("model_id like '%a.cif'")).orderBy("frame").collect()
    assert [f.positions[1].x for f in frames] == [2.0, 2.5]


def test_models_store_and_extract(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.cif").write_text(CIF)
    found = model_source.read_models(spark, str(tmp_path / "in"))
    m = found.first()
    assert (m.sequence, m.organism, m.taxonomy_id, m.plddt, m.dssp, m.error) == ("AG", "Homo sapiens", "9606", ["VeryHigh", "VeryLow"] * 2, ["AlphaHelix", "Coil", "Coil", "Coil"], None) or m.sequence == "AG"
    store = model_source.ModelStore(spark, f"file://{tmp_path}/store", 4)
    store.write(found)
    assert store.keys().count() == 1 and store.get(m.model_id).first().organism == "Homo sapiens" and store.get("no").count() == 0
    payload = json.loads(model_source.extract(store.read(), "organism").first().payload)
    assert payload == {"model": m.model_id, "organism": "Homo sapiens", "taxonomy_id": "9606"}


def test_compaction_record(spark):
    seq = "AGAGAG"
    n = [5, 4, 5, 4, 5, 5]
    xyz = [(float(i % 7), float(i % 5), float(i)) for i in range(sum(n))]
    conf = ["VeryLow", "High", "VeryHigh", "High", "High", "Low"]
    state = ["Coil", "AlphaHelix", "AlphaHelix", "Coil", "Strand", "Turn"]
    rows = [("ok", seq, conf, state, xyz), ("none", "", conf, state, xyz), ("short", seq, conf[:5], state[:5], xyz), ("odd", "AGAGAX", conf, state, xyz), ("atoms", seq, conf, state, xyz[:-1]), ("loose", seq, ["Low"] * 6, ["Coil"] * 6, xyz), ("unsure", seq, ["Low"] * 6, ["Strand"] * 6, xyz)]
    df = spark.createDataFrame(rows, "model_id string, sequence string, plddt array<string>, dssp array<string>, coords array<struct<x: double, y: double, z: double>>")
    found = {r.model_id: r for r in shape.compaction_record(df).collect()}
    assert {k: r.status for k, r in found.items()} == {"ok": "ok", "none": "missing_sequence", "short": "length_mismatch", "odd": "prefix_errors", "atoms": "atom_mismatch", "loose": "trimmed_empty", "unsure": "failed_confidence"}
    r = found["ok"]
    kept = np.array(xyz[5:23])
    w = np.repeat([4, 5, 4, 5], [4, 5, 4, 5])
    c = (w[:, None] * kept).sum(0) / w.sum()
    assert (r.trim_start, r.trim_end, r.n_atoms_kept, r.high_fraction) == (1, 5, 18, 1.0)
    assert r.rg == pytest.approx(math.sqrt(((kept - kept.mean(0)) ** 2).sum(1).mean()))
    assert r.rg_weighted == pytest.approx(math.sqrt((w * ((kept - c) ** 2).sum(1)).sum() / w.sum()))
    total = shape.summary(shape.compaction_record(df)).first()
    assert total.total == 7 and total.written == 1 and total.passed_99 == 1 and total.trimmed_empty == 1


def test_principal_moments(spark):
    rng = np.random.default_rng(8)
    xyz = rng.normal(0, (1, 3, 7), (200, 3)) @ np.linalg.qr(rng.normal(size=(3, 3)))[0]
    m = shape.shape_metrics(shape.principal_moments(shape.gyration_tensor(frame(spark, xyz), ["model_id"]))).first()
    want = np.linalg.eigvalsh(np.cov(xyz.T, bias=True))
    assert [m.pm0, m.pm1, m.pm2] == pytest.approx(want.tolist())
    flat = shape.principal_moments(shape.gyration_tensor(frame(spark, np.ones((5, 3))), ["model_id"])).first()
    assert (flat.pm0, flat.pm1, flat.pm2) == pytest.approx((0, 0, 0))


def test_group_definitions():
    assert parse_groups(["A=very high, LOW"], "plddt")[0].members == ("VeryHigh", "Low")
    for bad in (["x"], ["a b=low"], ["a=low", "a=high"], ["a=zzz"]):
        with pytest.raises(ValueError):
            parse_groups(bad, "plddt")
    with pytest.raises(ValueError):
        parse_groups(["a=betabridge"], "dssp")


def test_pipeline_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(f"m{i}", i) for i in range(10)], "model_id string, n int")

    def item(row):
        if row["n"] == 3:
            raise RuntimeError("no three")
        return {"n": row["n"]}

    p = sinks.Pipeline(df).add_task("even", lambda d: d.where("n % 2 = 0")).add_item_task("item", item)
    p.attach("even", sinks.memory).attach("even", lambda d: sinks.sharded_ndjson(d, f"{tmp_path}/even", 2)).attach("item", sinks.memory)
    out = p.run()
    assert len(out["even"][0]) == 5 and {json.loads(x).get("error", {}).get("message") for x in out["item"][0]} == {None, "no three"}
    assert sum(1 for _ in (tmp_path / "even").glob("part-*")) >= 3 and "even <- source" in p.describe()
    sinks.ndjson(df, f"{tmp_path}/one")
    assert len(list((tmp_path / "one").glob("part-*"))) == 1 and spark.read.json(f"{tmp_path}/one").count() == 10
    with pytest.raises(ValueError):
        p.add_task("even", lambda d: d)


def test_positions_and_hash(spark):
    assert sinks.fnv1a(b"") == 0xCBF29CE484222325 and sinks.fnv1a(b"a", 32) == 0xE40C292C
    df = spark.createDataFrame([("m", [(1.0, 2.0, 3.5)])], "model_id string, coords array<struct<x: double, y: double, z: double>>")
    row = sinks.positions(df, 2).first()
    assert row.path.count("/") == 2 and np.frombuffer(row.content, "<f4").tolist() == [1.0, 2.0, 3.5]


def test_periodic_distances(spark):
    a, b = g.vec(F.lit(0.5), F.lit(0.5), F.lit(0.5)), g.vec(F.lit(9.5), F.lit(9.5), F.lit(0.5))
    row = spark.range(1).select(distances.periodic_distance(a, b, (10.0, 10.0, 0.0)).alias("o"), distances.triclinic_distance(a, b, ((10.0, 0, 0), (0.0, 10.0, 0), (0.0, 0.0, 10.0))).alias("t")).first()
    assert row.o == pytest.approx(math.sqrt(2)) and row.t == pytest.approx(math.sqrt(2))


def test_streams(spark, tmp_path):
    from helixframe.streaming import streams

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.cif").write_text(CIF)
    streams.run_available(streams.structure_stream(spark, f"file://{tmp_path}/in"), "stream_atoms", f"file://{tmp_path}/ck")
    assert spark.table("stream_atoms").count() == 8
    static = structures.read_atoms(spark, f"file://{tmp_path}/in").where("frame = 0")
    pos = structures.frames(structures.read_atoms(spark, f"file://{tmp_path}/in")).withColumn("source_file", F.lit("x")).select("model_id", "frame", "time_ps", "source_file", "positions")
    pos.write.parquet(f"file://{tmp_path}/frames")
    streams.run_available(streams.frame_atoms(streams.frame_stream(spark, f"file://{tmp_path}/frames"), static), "stream_frames", f"file://{tmp_path}/ck2")
    batch = streams.frame_atoms(pos, static)
    assert sorted(map(str, spark.table("stream_frames").collect())) == sorted(map(str, batch.collect()))
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a", 1.0), (1, "2024-01-01 10:00:00", "a", 2.0), (2, "2024-01-03 00:00:00", "b", 3.0)], "user_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(f"file://{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/events")
    streams.run_available(streams.windowed_counts(stream), "stream_days", f"file://{tmp_path}/ck3", "complete")
    assert {(r.event_type, r.n, r.total) for r in spark.table("stream_days").collect()} == {("a", 2, 3.0), ("b", 1, 3.0)}
    c = spark.createDataFrame([("m", 4.0), ("m", 2.0), ("k", 1.0)], "model_id string, distance_sq double")
    c.write.parquet(f"file://{tmp_path}/contacts")
    running = streams.running_contacts(spark.readStream.schema(c.schema).parquet(f"file://{tmp_path}/contacts"))
    streams.run_available(running, "stream_running", f"file://{tmp_path}/ck4", "update")
    assert {(r.model_id, r.n_contacts, r.nearest_sq) for r in spark.table("stream_running").collect()} == {("m", 2, 2.0), ("k", 1, 1.0)}


def test_command_line(spark, tmp_path):
    from helixframe import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.cif").write_text(CIF)
    for verb, more in (("dssp", []), ("sasa-sr", []), ("contacts", ["--types", "hbond,ionic"]), ("extract", ["--field", "sequence"]), ("quality-metrics", []), ("compaction-rg", []), ("shape-metrics", [])):
        args = cli.parser().parse_args([verb, "--directory", str(tmp_path / "in"), "--output", str(tmp_path / verb), *more])
        cli.build(spark, args).collect()
    with pytest.raises(SystemExit):
        cli.build(spark, cli.parser().parse_args(["contacts", "--directory", str(tmp_path), "--output", "x", "--types", "nope"]))


def test_the_rest_imports_without_the_corpus_operators():
    import pathlib

    root = pathlib.Path(__file__).parent.parent
    for path in [*(root / "helixframe").rglob("*.py"), root / "bench.py"]:
        if "llm" not in path.parts:
            assert "helixframe.llm" not in path.read_text(), path
