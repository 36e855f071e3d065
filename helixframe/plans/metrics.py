"""Queries of compaction, shape, quality, sets of contacts, functions and output, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import interactions
from helixframe.operators import contact_set, quality_metrics, radius, shape
from helixframe.sources.adapters import PARTICLES_SQL, POINTS_SQL, RESIDUES_SQL, models, particles, points, residues
from helixframe.sources.models import extract

GROUPS = ("poor=verylow", "low_or_poor=low,verylow")
STRUCTURES = ("coil=coil,turn,bend", "helix=alphahelix,helix310,helixpi", "strand=strand")
SEGMENT = 3


def rg(spark, d):
    return shape.radius_of_gyration(particles(spark, d), ["model_id"]).select("model_id", "n", F.round("rg", 6).alias("rg"))


def rg_weighted(spark, d):
    return shape.weighted_rg(particles(spark, d), ["model_id"]).select("model_id", F.round("rg", 5).alias("rg"))


def tensor(spark, d):
    t = shape.gyration_tensor(particles(spark, d), ["model_id"])
    return t.select("model_id", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("cx", "cy", "cz", "xx", "yy", "zz", "xy", "xz", "yz")])


def shape_metrics(spark, d):
    m = shape.shape_metrics(shape.principal_moments(shape.gyration_tensor(points(spark, d), ["chain"])))
    return m.select("chain", "n", F.round("rg_sq", 6).alias("rg_sq"), F.round("kappa2", 6).alias("kappa2"), F.round(F.col("pm0") * F.col("pm1") * F.col("pm2"), 2).alias("det"))


def shape_asphericity(spark, d):
    m = shape.shape_metrics(shape.principal_moments(shape.gyration_tensor(particles(spark, d), ["model_id"])))
    return m.select("model_id", *[(F.round(c, 5) + 0.0).alias(c) for c in ("pm0", "pm1", "pm2", "asphericity", "acylindricity")])


def confidence(spark, d):
    return residues(spark, d).groupBy("model_id").agg(F.round(shape.confidence_fraction(F.col("plddt")), 9).alias("high_fraction"))


def trim(spark, d):
    t = shape.trim_report(residues(spark, d), ["model_id"])
    return t.select("model_id", "n_residues", "n_kept", "trimmed_start", "trimmed_end", F.round("confidence", 9).alias("confidence"), F.round("confidence_kept", 9).alias("confidence_kept"))


def atom_counts(spark, d):
    m = models(spark, d).select("model_id", "sequence", shape.atom_counts(F.col("sequence")).alias("counts"))
    sums = m.withColumn("prefix", shape.prefix_sums(F.col("counts")))
    return sums.select("model_id", F.length("sequence").cast("long").alias("n"), F.element_at("prefix", -1).alias("n_atoms"), F.element_at("prefix", 3).alias("third"))


def normalized(spark, d):
    g = shape.radius_of_gyration(points(spark, d), ["resname"])
    return g.select("resname", F.round(shape.normalized_rg(F.col("rg"), F.col("n")), 6).alias("rg_normalized"))


def thresholds(spark, d):
    c = residues(spark, d).groupBy("model_id").agg(F.avg((F.col("score") > 10).cast("double")).alias("f"))
    return c.select("model_id", *[shape.passes(F.col("f"), t).alias(f"passes_{round(t * 100)}") for t in shape.THRESHOLDS], shape.highest_passed(F.col("f")).alias("highest"))


def quality(spark, d):
    q = quality_metrics.quality_metrics(residues(spark, d), ["model_id"], quality_metrics.parse_groups(GROUPS, "plddt"), quality_metrics.parse_groups(STRUCTURES, "dssp"), ("poor",), SEGMENT)
    return q.select("model_id", "n_residues", *[F.round(c, 9).alias(c) if c.endswith("fraction") else F.col(c).cast("long").alias(c) for c in q.columns[2:]])


def _quality_sql() -> str:
    p = {"poor": "plddt = 'VeryLow'", "low_or_poor": "plddt IN ('Low', 'VeryLow')"}
    s = {"coil": "dssp IN ('Coil', 'Turn', 'Bend')", "helix": "dssp IN ('AlphaHelix', 'Helix3_10', 'HelixPi')", "strand": "dssp = 'Strand'"}
    share = lambda t, name: f"round(avg(CASE WHEN {t} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS {name}"
    cols = [share(t, f"plddt_{n}_fraction") for n, t in p.items()] + [share(t, f"dssp_{n}_fraction") for n, t in s.items()]
    cols += [share(f"{a} AND {b}", f"overlap_{n}__{m}_fraction") for n, a in p.items() for m, b in s.items()]
    return f"""WITH {RESIDUES_SQL}, fr AS (SELECT model_id, count(*) AS n_residues, {", ".join(cols)} FROM res GROUP BY 1),
isl AS (SELECT model_id, position, plddt = 'VeryLow' AS i, position - sum(CASE WHEN plddt = 'VeryLow' THEN 1 ELSE 0 END) OVER (PARTITION BY model_id ORDER BY position) AS g FROM res),
run AS (SELECT model_id, g, count(*) FILTER (i) AS run, count(*) AS n FROM isl GROUP BY 1, 2),
seg AS (SELECT model_id, count(*) FILTER (run > 0) AS plddt_poor_segment_count, max(run) AS plddt_poor_max_segment_len,
  round((sum(CASE WHEN run >= {SEGMENT} THEN run ELSE 0 END) / sum(n))::DOUBLE, 9) AS plddt_poor_long_segment_fraction FROM run GROUP BY 1)
SELECT * FROM fr JOIN seg USING (model_id)"""


def _records(spark, d):
    """Compaction records of models whose coordinates are placed on a fixed curve; rows that lack something keep their status."""
    m = models(spark, d)
    n = F.aggregate(shape.atom_counts(F.col("sequence")), F.lit(0), lambda a, c: a + c)
    xyz = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.cos(i * 0.7).alias("x"), F.sin(i * 0.7).alias("y"), (i * 0.15).cast("double").alias("z")))
    return shape.compaction_record(m.withColumn("coords", xyz), 0.2)


def compaction(spark, d):
    numbers = [F.round(c, 6).alias(c) for c in ("high_fraction", "rg", "rg_weighted", "rg_normalized", "highest_threshold")]
    whole = [F.coalesce(F.col(c), F.lit(-1)).cast("long").alias(c) for c in ("n_residues", "trim_start", "trim_end", "n_kept", "n_atoms_kept")]
    return _records(spark, d).select("model_id", "status", *whole, *numbers, F.col("passes")["0.80"].alias("passes_80"), F.col("passes")["0.99"].alias("passes_99"))


def compaction_summary(spark, d):
    return shape.summary(_records(spark, d))


# sets of contacts


def _contacts(spark, d, reach: float, parity: int):
    near = radius.self_join(points(spark, d), reach).where((F.col("i") + F.col("j")) % 3 != parity)
    kind = F.when((F.col("i") + F.col("j")) % 2 == 0, "Hydrophobic").otherwise("VanDerWaals")
    return near.select(F.col("i").alias("lhs"), F.col("j").alias("rhs"), kind.alias("type"), "distance_sq")


def _sets(spark, d):
    return _contacts(spark, d, 5.0, 0), _contacts(spark, d, 6.0, 1)


_D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"
_SETS_SQL = f"""WITH {POINTS_SQL}, prs AS (SELECT a.atom_id AS lhs, b.atom_id AS rhs, CASE WHEN (a.atom_id + b.atom_id) % 2 = 0 THEN 'Hydrophobic' ELSE 'VanDerWaals' END AS type, {_D2} AS d2 FROM pts a JOIN pts b ON a.atom_id < b.atom_id WHERE {_D2} <= 36.0),
l AS (SELECT * FROM prs WHERE d2 <= 25.0 AND (lhs + rhs) % 3 <> 0), r AS (SELECT * FROM prs WHERE (lhs + rhs) % 3 <> 1) """


def _rounded(df):
    return df.select("lhs", "rhs", "type", F.round("distance_sq", 6).alias("d2"))


def set_union(spark, d):
    return _rounded(contact_set.union(*_sets(spark, d)))


def set_intersection(spark, d):
    return _rounded(contact_set.intersection(*_sets(spark, d)))


def set_difference(spark, d):
    return _rounded(contact_set.difference(*_sets(spark, d)))


def set_symmetric(spark, d):
    return _rounded(contact_set.symmetric_difference(*_sets(spark, d)))


def set_insert(spark, d):
    return _rounded(contact_set.insert(*_sets(spark, d)))


def set_generic(spark, d):
    a, b = _sets(spark, d)
    return _rounded(contact_set.make_generic(contact_set.insert(a, b)))


def type_filter(spark, d):
    wanted = interactions.TypeSet.parse("hydrophobic | hbond")
    a, _ = _sets(spark, d)
    return _rounded(a.where(wanted.column(F.col("type"))))


def count_by_type(spark, d):
    return contact_set.count_by_type(_sets(spark, d)[1])


def type_codes(spark, d):
    a, _ = _sets(spark, d)
    return a.select("lhs", "rhs", interactions.code_column(F.col("type")).cast("long").alias("code"), interactions.short_column(F.col("type")).alias("short"))


def compact_json(spark, d):
    """A JSON text of every contact with its compact distance; a sink gathers them by type without a list in one task."""
    a, _ = _sets(spark, d)
    row = F.struct("lhs", "rhs", interactions.compact_number(F.col("distance_sq")).alias("d"))
    return a.select("type", "lhs", "rhs", F.to_json(row).alias("payload"))


# functions


def plddt_categories(spark, d):
    return residues(spark, d).groupBy("plddt").agg(F.count(F.lit(1)).alias("n"))


def fixed_scores(spark, d):
    r = residues(spark, d)
    return r.select("model_id", "position", F.format_string("%.1f", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(F.col("score") * 10 + 0.5) / 10))).alias("text"))


def category_letters(spark, d):
    from helixframe.sources.models import DSSP_LETTERS, PLDDT_LETTERS, letters

    return models(spark, d).select("model_id", letters(F.col("plddt"), PLDDT_LETTERS).alias("plddt"), letters(F.col("dssp"), DSSP_LETTERS).alias("dssp"))


def extract_sequence(spark, d):
    return extract(models(spark, d), "sequence")


def extract_organism(spark, d):
    return extract(models(spark, d), "organism")


def json_props(spark, d):
    from helixframe.sources.adapters import table

    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.to_json(F.struct("event_type", "user_id")).alias("payload"))


_TRIM_SQL = f"""WITH {RESIDUES_SQL}, k AS (SELECT *, NOT (dssp IN ('Coil', 'Turn', 'Bend') AND plddt IN ('Low', 'VeryLow')) AS keep FROM res),
b AS (SELECT model_id, min(position) FILTER (keep) AS lo, max(position) FILTER (keep) AS hi FROM k GROUP BY 1),
m AS (SELECT k.*, lo, hi, coalesce(position BETWEEN lo AND hi, false) AS inside, CASE WHEN plddt IN ('High', 'VeryHigh') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sure FROM k JOIN b USING (model_id))
SELECT model_id, count(*) AS n_residues, count(*) FILTER (inside) AS n_kept, coalesce(sum(CASE WHEN position < lo THEN 1 WHEN position >= lo THEN 0 END), count(*))::BIGINT AS trimmed_start,
  coalesce(sum(CASE WHEN position > hi THEN 1 WHEN position <= hi THEN 0 END), 0)::BIGINT AS trimmed_end, round(avg(sure), 9) AS confidence, round(coalesce(avg(sure) FILTER (inside), 0.0), 9) AS confidence_kept FROM m GROUP BY 1"""
_ATOMS_SQL = "CASE substr('ARNDCQEGHILKMFPSTWYV', (position % 20 + 1)::INT, 1) " + " ".join(f"WHEN '{a}' THEN {n}" for a, n in shape.ATOMS.items()) + " END"
_MOMENTS_SQL = f"""WITH {PARTICLES_SQL}, t AS (SELECT model_id, var_pop(x) AS xx, var_pop(y) AS yy, var_pop(z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM par GROUP BY 1),
q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM t), p AS (SELECT *, sqrt(((xx-q)*(xx-q) + (yy-q)*(yy-q) + (zz-q)*(zz-q) + 2*(xy*xy + xz*xz + yz*yz)) / 6) AS p FROM q),
r AS (SELECT *, CASE WHEN p > 1e-12 THEN acos(greatest(-1.0, least(1.0, (((xx-q)/p)*(((yy-q)/p)*((zz-q)/p) - (yz/p)*(yz/p)) - (xy/p)*((xy/p)*((zz-q)/p) - (yz/p)*(xz/p)) + (xz/p)*((xy/p)*(yz/p) - ((yy-q)/p)*(xz/p))) / 2))) / 3 END AS phi FROM p),
e AS (SELECT model_id, q, CASE WHEN phi IS NULL THEN q ELSE q + 2*p*cos(phi) END AS pm2, CASE WHEN phi IS NULL THEN q ELSE q + 2*p*cos(phi + 2.0943951023931953) END AS pm0 FROM r),
m AS (SELECT model_id, pm0, 3*q - pm0 - pm2 AS pm1, pm2 FROM e)
SELECT model_id, round(pm0, 5) + 0.0::DOUBLE AS pm0, round(pm1, 5) + 0.0::DOUBLE AS pm1, round(pm2, 5) + 0.0::DOUBLE AS pm2, round(pm2 - 0.5*(pm0 + pm1), 5) + 0.0::DOUBLE AS asphericity, round(pm1 - pm0, 5) + 0.0::DOUBLE AS acylindricity FROM m"""
_RECORDS_SQL = f"""WITH {RESIDUES_SQL}, c AS (SELECT model_id, position, {_ATOMS_SQL} + CASE WHEN position = max(position) OVER (PARTITION BY model_id) THEN 1 ELSE 0 END AS cnt,
  CASE WHEN plddt IN ('High', 'VeryHigh') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sure, NOT (dssp IN ('Coil', 'Turn', 'Bend') AND plddt IN ('Low', 'VeryLow')) AS keep FROM res),
r AS (SELECT *, sum(cnt) OVER (PARTITION BY model_id ORDER BY position) - cnt AS before FROM c),
b AS (SELECT model_id, count(*) AS n_residues, min(position) FILTER (keep) AS lo, max(position) FILTER (keep) AS hi FROM c GROUP BY 1),
k AS (SELECT r.* FROM r JOIN b USING (model_id) WHERE position BETWEEN lo AND hi),
h AS (SELECT model_id, avg(sure) AS f, count(*) AS n_kept, sum(cnt) AS n_atoms FROM k GROUP BY 1),
i AS (SELECT model_id, cnt::DOUBLE AS w, unnest(range(before::BIGINT + 1, (before + cnt)::BIGINT + 1))::DOUBLE AS i FROM k),
a AS (SELECT model_id, w, cos(i * 0.7::DOUBLE) AS x, sin(i * 0.7::DOUBLE) AS y, i * 0.15::DOUBLE AS z FROM i),
m AS (SELECT model_id, sum(w*x)/sum(w) AS cx, sum(w*y)/sum(w) AS cy, sum(w*z)/sum(w) AS cz FROM a GROUP BY 1),
g AS (SELECT model_id, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS rg, sqrt(sum(w*((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz))) / sum(w)) AS rgw FROM a JOIN m USING (model_id) GROUP BY 1),
s AS (SELECT b.*, h.*EXCLUDE(model_id), g.rg, g.rgw, CASE WHEN lo IS NULL THEN 'trimmed_empty' WHEN f < 0.2 THEN 'failed_confidence' ELSE 'ok' END AS status FROM b LEFT JOIN h USING (model_id) LEFT JOIN g USING (model_id)),
rec AS (SELECT model_id::VARCHAR AS model_id, status, n_residues, CASE WHEN status = 'ok' THEN lo - 1 ELSE -1 END AS trim_start, CASE WHEN status = 'ok' THEN hi ELSE -1 END AS trim_end, CASE WHEN status = 'ok' THEN n_kept ELSE -1 END AS n_kept, CASE WHEN status = 'ok' THEN n_atoms ELSE -1 END::BIGINT AS n_atoms_kept,
  CASE WHEN status = 'ok' THEN f END AS f, CASE WHEN status = 'ok' THEN rg END AS rg, CASE WHEN status = 'ok' THEN rgw END AS rgw FROM s) """


QUERIES = {
    "r1_radius_of_gyration": (rg, f"WITH {PARTICLES_SQL} SELECT model_id, count(*) AS n, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) AS rg FROM par GROUP BY 1"),
    "r2_weighted_rg": (rg_weighted, f"WITH {PARTICLES_SQL}, m AS (SELECT model_id, sum(weight) AS w, sum(weight*x)/sum(weight) AS cx, sum(weight*y)/sum(weight) AS cy, sum(weight*z)/sum(weight) AS cz FROM par GROUP BY 1) SELECT model_id, round(sqrt(sum(weight*((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz)))/max(w)), 5) AS rg FROM par JOIN m USING (model_id) GROUP BY 1"),
    "r3_gyration_tensor": (tensor, f"WITH {PARTICLES_SQL} SELECT model_id, count(*) AS n, round(avg(x), 6) + 0.0::DOUBLE AS cx, round(avg(y), 6) + 0.0::DOUBLE AS cy, round(avg(z), 6) + 0.0::DOUBLE AS cz, round(var_pop(x), 6) + 0.0::DOUBLE AS xx, round(var_pop(y), 6) + 0.0::DOUBLE AS yy, round(var_pop(z), 6) + 0.0::DOUBLE AS zz, round(covar_pop(x, y), 6) + 0.0::DOUBLE AS xy, round(covar_pop(x, z), 6) + 0.0::DOUBLE AS xz, round(covar_pop(y, z), 6) + 0.0::DOUBLE AS yz FROM par GROUP BY 1"),
    "r4_shape_metrics": (shape_metrics, f"""WITH {POINTS_SQL}, t AS (SELECT chain, count(*) AS n, var_pop(x) AS a, var_pop(y) AS b, var_pop(z) AS c, covar_pop(x, y) AS d, covar_pop(x, z) AS e, covar_pop(y, z) AS f FROM pts GROUP BY 1)
SELECT chain, n, round(a+b+c, 6) AS rg_sq, round(1 - 3*(a*b-d*d+a*c-e*e+b*c-f*f)/((a+b+c)*(a+b+c)), 6) AS kappa2, round(a*(b*c-f*f)-d*(d*c-f*e)+e*(d*f-b*e), 2) AS det FROM t"""),
    "r4_principal_moments": (shape_asphericity, _MOMENTS_SQL),
    "r5_confidence_fraction": (confidence, f"WITH {RESIDUES_SQL} SELECT model_id, round(avg(CASE WHEN plddt IN ('High', 'VeryHigh') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS high_fraction FROM res GROUP BY 1"),
    "r6_trim_tails": (trim, _TRIM_SQL),
    "r7_atom_counts": (atom_counts, f"WITH {RESIDUES_SQL} SELECT model_id::VARCHAR AS model_id, count(*) AS n, (sum({_ATOMS_SQL}) + 1)::BIGINT AS n_atoms, (sum(CASE WHEN position <= 2 THEN {_ATOMS_SQL} END) + CASE WHEN count(*) = 2 THEN 1 ELSE 0 END)::BIGINT AS third FROM res GROUP BY 1"),
    "r8_normalized_rg": (normalized, f"WITH {POINTS_SQL} SELECT resname, round(sqrt(var_pop(x)+var_pop(y)+var_pop(z)) / cbrt(count(*)), 6) AS rg_normalized FROM pts GROUP BY 1"),
    "r9_thresholds": (thresholds, f"WITH {RESIDUES_SQL}, f AS (SELECT model_id, avg(CASE WHEN score > 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS f FROM res GROUP BY 1) SELECT model_id, f >= 0.8 AS passes_80, f >= 0.9 AS passes_90, f >= 0.95 AS passes_95, f >= 0.99 AS passes_99, CASE WHEN f >= 0.99 THEN 0.99 WHEN f >= 0.95 THEN 0.95 WHEN f >= 0.9 THEN 0.9 WHEN f >= 0.8 THEN 0.8 ELSE 0.0 END::DOUBLE AS highest FROM f"),
    "r10_compaction_records": (compaction, _RECORDS_SQL + """SELECT model_id, status, n_residues, trim_start, trim_end, n_kept, n_atoms_kept, round(f, 6) AS high_fraction, round(rg, 6) AS rg, round(rgw, 6) AS rg_weighted, round(rg / cbrt(n_kept), 6) AS rg_normalized,
  CASE WHEN f >= 0.99 THEN 0.99 WHEN f >= 0.95 THEN 0.95 WHEN f >= 0.9 THEN 0.9 WHEN f >= 0.8 THEN 0.8 WHEN f IS NOT NULL THEN 0.0 END::DOUBLE AS highest_threshold, f >= 0.8 AS passes_80, f >= 0.99 AS passes_99 FROM rec"""),
    "r12_quality_metrics": (quality, _quality_sql()),
    "r19_compaction_summary": (compaction_summary, _RECORDS_SQL + "SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS written, " + ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in shape.REASONS) + ", " + ", ".join(f"count(*) FILTER (f >= {t}) AS passed_{round(t * 100)}" for t in shape.THRESHOLDS) + " FROM rec"),
    "r21_contacts_by_type": (count_by_type, _SETS_SQL + "SELECT type, count(*) AS n_contacts FROM r GROUP BY 1"),
    "u1_union": (set_union, _SETS_SQL + "SELECT lhs, rhs, type, round(d2, 6) AS d2 FROM (SELECT * FROM l UNION SELECT * FROM r)"),
    "u2_intersection": (set_intersection, _SETS_SQL + "SELECT lhs, rhs, type, round(d2, 6) AS d2 FROM (SELECT * FROM l INTERSECT SELECT * FROM r)"),
    "u3_difference": (set_difference, _SETS_SQL + "SELECT lhs, rhs, type, round(d2, 6) AS d2 FROM (SELECT * FROM l EXCEPT SELECT * FROM r)"),
    "u4_symmetric_difference": (set_symmetric, _SETS_SQL + "SELECT lhs, rhs, type, round(d2, 6) AS d2 FROM ((SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL (SELECT * FROM r EXCEPT SELECT * FROM l))"),
    "u5_insert": (set_insert, _SETS_SQL + "SELECT lhs, rhs, type, round(d2, 6) AS d2 FROM (SELECT * FROM l UNION ALL SELECT * FROM r)"),
    "u6_make_generic": (set_generic, _SETS_SQL + "SELECT lhs, rhs, 'Generic' AS type, round(min(d2), 6) AS d2 FROM (SELECT * FROM l UNION ALL SELECT * FROM r) GROUP BY 1, 2"),
    "u7_type_filter": (type_filter, _SETS_SQL + "SELECT lhs, rhs, type, round(d2, 6) AS d2 FROM l WHERE type = 'Hydrophobic'"),
    "f1_plddt_categories": (plddt_categories, f"WITH {RESIDUES_SQL} SELECT plddt, count(*) AS n FROM res GROUP BY 1"),
    "f2_category_letters": (category_letters, f"WITH {RESIDUES_SQL} SELECT model_id::VARCHAR AS model_id, string_agg(CASE plddt WHEN 'VeryHigh' THEN 'E' WHEN 'High' THEN 'H' WHEN 'Low' THEN 'L' ELSE 'P' END, '' ORDER BY position) AS plddt, string_agg(CASE dssp WHEN 'Coil' THEN 'C' WHEN 'AlphaHelix' THEN 'H' WHEN 'Strand' THEN 'E' WHEN 'Turn' THEN 'T' WHEN 'Bend' THEN 'S' END, '' ORDER BY position) AS dssp FROM res GROUP BY 1"),
    "f3_fixed_scores": (fixed_scores, f"WITH {RESIDUES_SQL} SELECT model_id, position, printf('%.1f', greatest(0.0, least(100.0, floor(score * 10 + 0.5) / 10))) AS text FROM res"),
    "f5_compact_contacts": (compact_json, _SETS_SQL + """SELECT type, lhs, rhs, '{"lhs":' || lhs || ',"rhs":' || rhs || ',"d":"' || regexp_replace(regexp_replace(printf('%.2f', d2), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || '"}' AS payload FROM l"""),
    "f7_json": (json_props, "SELECT event_id, (props->>'$.k')::BIGINT AS k, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS payload FROM events"),
    "f10_type_codes": (type_codes, _SETS_SQL + "SELECT lhs, rhs, CASE type WHEN 'Hydrophobic' THEN 2 ELSE 14 END::BIGINT AS code, CASE type WHEN 'Hydrophobic' THEN 'hp' ELSE 'vdw' END AS short FROM l"),
    "x7_extract_sequence": (extract_sequence, f"""WITH {RESIDUES_SQL}, s AS (SELECT model_id::VARCHAR AS model_id, string_agg(substr('ARNDCQEGHILKMFPSTWYV', (position % 20 + 1)::INT, 1), '' ORDER BY position) AS s FROM res GROUP BY 1) SELECT model_id, '{{"model":"' || model_id || '","sequence":"' || s || '"}}' AS payload FROM s"""),
    "x7_extract_organism": (extract_organism, f"""WITH {RESIDUES_SQL} SELECT DISTINCT model_id::VARCHAR AS model_id, '{{"model":"' || model_id || '","organism":"Unknown","taxonomy_id":"N/A"}}' AS payload FROM res"""),
}
