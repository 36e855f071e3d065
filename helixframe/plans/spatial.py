"""Queries of radius joins, distances, selections and entity predicates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions.geometry import vec
from helixframe.functions.interactions import contact_label, entity_id, entity_index, entity_kind
from helixframe.functions.selection import select_atoms
from helixframe.operators import contact_set, contacts, distances, near, radius, topology
from helixframe.sources.adapters import POINTS_SQL, points

RADIUS, STEP = 5.0, 50
D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"
PAIRS_SQL = f"{POINTS_SQL}, prs AS (SELECT a.atom_id AS i, b.atom_id AS j, {D2} AS d2, a.chain AS ca, b.chain AS cb, a.resid AS ra, b.resid AS rb FROM pts a JOIN pts b ON a.atom_id < b.atom_id WHERE {D2} <= {RADIUS * RADIUS})"
BOX = (60.0, 60.0, 60.0)
SELECTION = "(resid 4-30 or resname R07 R11) and not resname R05"


def self_join(spark, d):
    near = radius.self_join(points(spark, d), RADIUS, residual=(F.col("a.chain") == F.col("b.chain")) & (F.abs(F.col("a.resid") - F.col("b.resid")) > 1), keep=["chain"])
    return near.groupBy(F.col("chain_i").alias("chain")).agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.sum("distance_sq"), 6).alias("sum_d2"))


def self_pairs(spark, d):
    return radius.self_join(points(spark, d), RADIUS).select("i", "j", F.round("distance_sq", 6).alias("d2"))


def cross_pairs(spark, d):
    """Queries are the points whose id is divisible by STEP, against all points."""
    p = points(spark, d)
    return radius.cross_join(p.where(F.col("atom_id") % STEP == 0), p, 2 * RADIUS).select("i", "j", F.round("distance_sq", 6).alias("d2"))


def chain_cross(spark, d):
    p = points(spark, d)
    found = radius.cross_join(p.where("chain < '5'"), p.where("chain >= '5'"), RADIUS)
    return found.select("i", "j", F.round("distance_sq", 6).alias("d2"))


def brute(spark, d):
    return radius.nested_loop(points(spark, d), RADIUS).select("i", "j", F.round("distance_sq", 6).alias("d2"))


def _typed(spark, d):
    return points(spark, d).withColumns({"atom_type": (F.col("atom_id") % 8).cast("int"), "altloc": F.substring(F.lit(" AB"), (F.col("atom_id") % 3 + 1).cast("int"), F.lit(1))}).withColumn("altloc", F.trim("altloc"))


def find_self(spark, d):
    a = _typed(spark, d).where(F.col("atom_type").bitwiseAND(F.lit(1)) != 0)
    tester = lambda x, y, d2: F.when((x["chain"] != y["chain"]) & (d2 > 1.0), F.when(d2 < 12.0, "Hydrophobic").otherwise("VanDerWaals"))
    return contacts.find_contacts(a, None, RADIUS, tester, model=[]).select("lhs", "rhs", "type", F.round("distance_sq", 6).alias("d2"))


def find_cross(spark, d):
    t = _typed(spark, d)
    a, b = t.where(F.col("atom_type").bitwiseAND(F.lit(1)) != 0), t.where(F.col("atom_type").bitwiseAND(F.lit(2)) != 0)
    return contacts.find_contacts(a, b, RADIUS, model=[]).select("lhs", "rhs", "type", F.round("distance_sq", 6).alias("d2"))


_ALT = "(CASE {0}.atom_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'A' ELSE 'B' END)"
_OK = f"({_ALT.format('a')} = '' OR {_ALT.format('b')} = '' OR {_ALT.format('a')} = {_ALT.format('b')})"


def residue_gap(spark, d):
    p = points(spark, d).withColumns({"element": F.when(F.col("atom_id") % 5 == 0, "H").otherwise("C"), "resname": F.when(F.col("atom_id") % 7 == 0, "HOH").otherwise("ALA")})
    return contacts.residue_gap_neighbours(p, RADIUS, 2, model=[]).select("i", "j", F.round("distance_sq", 6).alias("d2"))


def neighbour_lists(spark, d):
    lists = radius.neighbour_lists(radius.self_join(points(spark, d), RADIUS))
    return lists.select("i", F.size("neighbours").alias("n"), F.col("neighbours")[0]["j"].alias("nearest"), F.round(F.col("neighbours")[0]["d"], 6).alias("d"))


def csr(spark, d):
    p = points(spark, d)
    lists = radius.neighbour_lists(radius.self_join(p, RADIUS)).select("i", F.size("neighbours").alias("n"))
    counts = p.select(F.col("atom_id").alias("i")).join(lists, "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("n"))
    return radius.offsets(counts, "i", "n")


def resolve(spark, d):
    p = points(spark, d).withColumn("name", F.concat(F.lit("C"), (F.col("atom_id") % 4).cast("string")))
    near = radius.self_join(p, RADIUS / 2).select(F.col("i").alias("lhs"), F.col("j").alias("rhs"), "distance_sq")
    met = contact_set.resolve(near, p)
    label = lambda key, s: contact_label(F.col(key), *[F.col(f"{c}_{s}") for c in ("name", "resid", "resname", "chain")])
    return met.select(label("lhs", "l").alias("label_i"), label("rhs", "r").alias("label_j"), F.round("distance_sq", 6).alias("d2"))


def tiling(spark, d):
    """Pairs of blocks of a file list, upper triangle with the diagonal."""
    return distances.tiles(points(spark, d), "atom_id", 64)


def tiling_across(spark, d):
    """Blocks of queries by blocks of targets."""
    p = points(spark, d)
    return distances.tiles_across(p.where("chain < '5'"), p, "atom_id", 32, 128)


def matrix(spark, d):
    """The distance matrix of every STEP-th point in blocks of 64 columns, each block summed up."""
    p = points(spark, d)
    m = distances.matrix_blocks(p.where(F.col("atom_id") % STEP == 0), p, 64)
    return m.select("i", "block", "first_j", F.size("d").cast("long").alias("n"), F.round(F.aggregate("d", F.lit(0.0), lambda s, x: s + x), 4).alias("sum_d"), F.round(F.col("d")[0], 6).alias("first_d"))


def fitted(spark, d):
    """Neighbours that points of some chains have among the points of others."""
    p = points(spark, d)
    found = radius.Neighbours(RADIUS).fit(p.where("chain >= '5'")).query(p.where("chain < '5'"))
    return found.select("i", F.size("neighbours").cast("long").alias("n"), F.col("neighbours")[0]["j"].alias("nearest"), F.round(F.col("neighbours")[0]["d"], 6).alias("d"))


def cdist(spark, d):
    p = points(spark, d)
    return distances.cdist(p.where(F.col("atom_id") % STEP == 0), p).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d"), 4).alias("sum_d"), F.round(F.max("d"), 6).alias("max_d"))


def pdist(spark, d):
    return distances.pdist(points(spark, d), ["chain"]).groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d"), 4).alias("sum_d"))


def pairwise(spark, d):
    return distances.pairwise(points(spark, d), ["chain"], squared=True).groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d"), 3).alias("sum_d2"))


def point_distance(spark, d):
    return points(spark, d).select("atom_id", F.round(distances.point_distance(vec("x", "y", "z"), vec(F.lit(1.0), F.lit(2.0), F.lit(3.0))), 6).alias("d"))


def periodic(spark, d):
    p = points(spark, d)
    dist = distances.periodic_distance(vec("a.x", "a.y", "a.z"), vec("b.x", "b.y", "b.z"), BOX)
    met = p.alias("a").join(p.alias("b"), F.col("b.atom_id") == F.col("a.atom_id") + 1)
    return met.select(F.col("a.atom_id").alias("i"), F.round(dist, 6).alias("d"))


def triclinic(spark, d):
    p = points(spark, d)
    dist = distances.triclinic_distance(vec("a.x", "a.y", "a.z"), vec("b.x", "b.y", "b.z"), ((60.0, 0.0, 0.0), (20.0, 55.0, 0.0), (10.0, 15.0, 50.0)))
    met = p.alias("a").join(p.alias("b"), F.col("b.atom_id") == F.col("a.atom_id") + 1)
    return met.select(F.col("a.atom_id").alias("i"), F.round(dist, 6).alias("d"))


def indexed(spark, d):
    p = points(spark, d)
    pairs = p.select(F.col("atom_id").alias("i"), (F.col("atom_id") + 3).alias("j"))
    return distances.indexed_distances(pairs, p).select("i", "j", F.round("d", 6).alias("d"))


def property_projection(spark, d):
    return points(spark, d).select("atom_id", "resname", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("z", 6).alias("z"))


def selection(spark, d):
    return select_atoms(points(spark, d), SELECTION).select("atom_id", "resid", "resname")


def type_predicates(spark, d):
    t = points(spark, d).withColumn("atom_type", ((F.col("atom_id") * 37) % 131072).cast("int"))
    return t.select("atom_id", topology.has(F.col("atom_type"), "HbondDonor").alias("donor"), (F.col("atom_type").bitwiseAND(F.lit(3)) == 3).alias("both"), (F.col("atom_type") == 0).alias("none"), F.bit_count(F.col("atom_type").cast("long")).cast("long").alias("n_types"), F.size(topology.type_names(F.col("atom_type"))).cast("long").alias("n_names"))


def ns_filters(spark, d):
    p = points(spark, d)
    pairs = distances.within(radius.self_join(p, RADIUS), 4.0)
    return distances.touching(pairs, p.where("chain = '3'").select("atom_id")).select("i", "j", F.round("distance_sq", 6).alias("d2"))


def residue_table(spark, d):
    p = points(spark, d).withColumn("model_id", F.lit(0))
    return topology.residues(p, ["model_id"]).select("res_idx", "chain", "resid", "resname", "n_atoms").withColumn("res_idx", F.col("res_idx").cast("long"))


def factorized(spark, d):
    found = topology.factorize(points(spark, d), ["resname"], "atom_id", ["chain"])
    return found.select("atom_id", "chain", F.col("factor").cast("long").alias("factor"))


def residue_classes(spark, d):
    names = F.element_at(F.array(*[F.lit(x) for x in ("ALA", "HOH", "DA", "HEM", "MSE")]), (F.col("atom_id") % 5 + 1).cast("int"))
    return points(spark, d).groupBy(topology.residue_class(names).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def subset(spark, d):
    """The subset of one chain: atoms renumbered in order, bonds kept only with both ends."""
    p = points(spark, d)
    kept = radius.renumber(p.where("chain = '2'"), "atom_id")
    bonds = radius.self_join(p, RADIUS).select("i", "j")
    ids = kept.select("atom_id", "new_id")
    met = bonds.join(ids.withColumnsRenamed({"atom_id": "i", "new_id": "a"}), "i").join(ids.withColumnsRenamed({"atom_id": "j", "new_id": "b"}), "j")
    return met.select("a", "b")


def entity_ids(spark, d):
    kind = F.element_at(F.array(F.lit("atom"), F.lit("ring"), F.lit("group")), (F.col("atom_id") % 3 + 1).cast("int"))
    made = points(spark, d).select("atom_id", entity_id(kind, F.col("atom_id")).alias("eid"))
    return made.select("atom_id", "eid", entity_kind(F.col("eid")).alias("kind"), entity_index(F.col("eid")).alias("idx"))


def nearest_top2(spark, d):
    """The two nearest neighbours of each point, the shape of keeping the two best hydrogen bonds."""
    return near.nearest(points(spark, d), 2, 2 * RADIUS, [])


QUERIES = {
    "j1_radius_self_join": (self_join, f"WITH {PAIRS_SQL} SELECT ca AS chain, count(*) AS n_pairs, round(sum(d2), 6) AS sum_d2 FROM prs WHERE ca = cb AND abs(ra - rb) > 1 GROUP BY ca"),
    "j1_radius_self_pairs": (self_pairs, f"WITH {PAIRS_SQL} SELECT i, j, round(d2, 6) AS d2 FROM prs"),
    "j2_radius_cross_join": (cross_pairs, f"WITH {POINTS_SQL} SELECT a.atom_id AS i, b.atom_id AS j, round({D2}, 6) AS d2 FROM pts a, pts b WHERE a.atom_id % {STEP} = 0 AND {D2} <= {4 * RADIUS * RADIUS}"),
    "j3_chain_cross_join": (chain_cross, f"WITH {POINTS_SQL} SELECT a.atom_id AS i, b.atom_id AS j, round({D2}, 6) AS d2 FROM pts a, pts b WHERE a.chain < '5' AND b.chain >= '5' AND {D2} <= {RADIUS * RADIUS}"),
    "j4_brute_force": (brute, f"WITH {PAIRS_SQL} SELECT i, j, round(d2, 6) AS d2 FROM prs"),
    "j6_find_contacts_self": (find_self, f"WITH {POINTS_SQL} SELECT a.atom_id AS lhs, b.atom_id AS rhs, CASE WHEN {D2} < 12.0 THEN 'Hydrophobic' ELSE 'VanDerWaals' END AS type, round({D2}, 6) AS d2 FROM pts a JOIN pts b ON a.atom_id < b.atom_id WHERE a.atom_id % 2 = 1 AND b.atom_id % 2 = 1 AND {D2} <= 25.0 AND {D2} > 1.0 AND a.chain <> b.chain AND {_OK}"),
    "j7_find_contacts_cross": (find_cross, f"WITH {POINTS_SQL} SELECT a.atom_id AS lhs, b.atom_id AS rhs, 'Generic' AS type, round({D2}, 6) AS d2 FROM pts a JOIN pts b ON a.atom_id < b.atom_id WHERE ((a.atom_id % 2 = 1 AND (b.atom_id // 2) % 2 = 1) OR (b.atom_id % 2 = 1 AND (a.atom_id // 2) % 2 = 1)) AND {D2} <= 25.0 AND {_OK}"),
    "j9_residue_gap": (residue_gap, f"WITH {PAIRS_SQL} SELECT i, j, round(d2, 6) AS d2 FROM prs WHERE i % 5 <> 0 AND j % 5 <> 0 AND (abs(ra - rb) > 2 OR i % 7 = 0 OR j % 7 = 0)"),
    "j10_neighbour_lists": (neighbour_lists, f"WITH {PAIRS_SQL}, bth AS (SELECT i, j, d2 FROM prs UNION ALL SELECT j, i, d2 FROM prs), rnk AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sqrt(d2), j) AS r, count(*) OVER (PARTITION BY i) AS n FROM bth) SELECT i, n, j AS nearest, round(sqrt(d2), 6) AS d FROM rnk WHERE r = 1"),
    "j11_csr": (csr, f"WITH {PAIRS_SQL}, bth AS (SELECT i FROM prs UNION ALL SELECT j FROM prs), cnt AS (SELECT p.atom_id AS i, count(b.i) AS n FROM pts p LEFT JOIN bth b ON b.i = p.atom_id GROUP BY 1) SELECT i, n, (sum(n) OVER (ORDER BY i) - n)::BIGINT AS indptr FROM cnt"),
    "j12_resolve": (resolve, f"""WITH {PAIRS_SQL} SELECT concat_ws('-', i, 'C' || (i % 4), ra, printf('R%02d', i % 20), ca) AS label_i, concat_ws('-', j, 'C' || (j % 4), rb, printf('R%02d', j % 20), cb) AS label_j, round(d2, 6) AS d2 FROM prs WHERE d2 <= {RADIUS * RADIUS / 4}"""),
    "j13_tiling": (tiling, f"WITH {POINTS_SQL}, blk AS (SELECT atom_id // 64 AS b, count(*) AS n FROM pts GROUP BY 1) SELECT a.b AS row_block, c.b AS col_block, (CASE WHEN a.b = c.b THEN a.n * (a.n - 1) // 2 ELSE a.n * c.n END)::BIGINT AS n_pairs FROM blk a JOIN blk c ON a.b <= c.b"),
    "j10_fitted_neighbours": (fitted, f"WITH {POINTS_SQL}, m AS (SELECT a.atom_id AS i, b.atom_id AS j, sqrt({D2}) AS d FROM pts a JOIN pts b ON a.chain < '5' AND b.chain >= '5' AND {D2} <= {RADIUS * RADIUS}), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r, count(*) OVER (PARTITION BY i) AS n FROM m) SELECT i, n, j AS nearest, round(d, 6) AS d FROM r WHERE r = 1"),
    "j13_tiling_across": (tiling_across, f"WITH {POINTS_SQL}, q AS (SELECT atom_id // 32 AS b, count(*) AS n FROM pts WHERE chain < '5' GROUP BY 1), t AS (SELECT atom_id // 128 AS b, count(*) AS n FROM pts GROUP BY 1) SELECT q.b AS row_block, t.b AS col_block, (q.n * t.n)::BIGINT AS n_pairs FROM q, t"),
    "d5_matrix_blocks": (matrix, f"WITH {POINTS_SQL}, c AS (SELECT *, row_number() OVER (ORDER BY atom_id) - 1 AS col FROM pts) SELECT a.atom_id AS i, b.col // 64 AS block, min(b.atom_id) AS first_j, count(*) AS n, round(sum(sqrt({D2})), 4) AS sum_d, round(arg_min(sqrt({D2}), b.col), 6) AS first_d FROM pts a, c b WHERE a.atom_id % {STEP} = 0 GROUP BY 1, 2"),
    "d1_point_distance": (point_distance, f"WITH {POINTS_SQL} SELECT atom_id, round(sqrt((x-1)*(x-1)+(y-2)*(y-2)+(z-3)*(z-3)), 6) AS d FROM pts"),
    "d2_cdist": (cdist, f"WITH {POINTS_SQL} SELECT a.atom_id AS i, count(*) AS n, round(sum(sqrt({D2})), 4) AS sum_d, round(max(sqrt({D2})), 6) AS max_d FROM pts a, pts b WHERE a.atom_id % {STEP} = 0 GROUP BY 1"),
    "d3_pdist": (pdist, f"WITH {POINTS_SQL} SELECT a.chain, count(*) AS n, round(sum(sqrt({D2})), 4) AS sum_d FROM pts a JOIN pts b ON a.chain = b.chain AND a.atom_id < b.atom_id GROUP BY 1"),
    "d4_pairwise": (pairwise, f"WITH {POINTS_SQL} SELECT a.chain, count(*) AS n, round(sum({D2}), 3) AS sum_d2 FROM pts a JOIN pts b ON a.chain = b.chain GROUP BY 1"),
    "d6_periodic_orthorhombic": (periodic, f"""WITH {POINTS_SQL}, dlt AS (SELECT a.atom_id AS i, a.x-b.x AS x, a.y-b.y AS y, a.z-b.z AS z FROM pts a JOIN pts b ON b.atom_id = a.atom_id + 1),
img AS (SELECT i, x-60*round(x/60) AS x, y-60*round(y/60) AS y, z-60*round(z/60) AS z FROM dlt) SELECT i, round(sqrt(x*x+y*y+z*z), 6) AS d FROM img"""),
    "d6_periodic_triclinic": (triclinic, f"""WITH {POINTS_SQL}, dlt AS (SELECT a.atom_id AS i, a.x-b.x AS x, a.y-b.y AS y, a.z-b.z AS z FROM pts a JOIN pts b ON b.atom_id = a.atom_id + 1),
k AS (SELECT unnest(range(-3, 4)) AS k), img AS (SELECT i, x+60*p.k+20*q.k+10*r.k AS x, y+55*q.k+15*r.k AS y, z+50*r.k AS z FROM dlt, k p, k q, k r)
SELECT i, round(sqrt(min(x*x+y*y+z*z)), 6) AS d FROM img GROUP BY i"""),
    "d7_indexed_distances": (indexed, f"WITH {POINTS_SQL} SELECT a.atom_id AS i, b.atom_id AS j, round(sqrt({D2}), 6) AS d FROM pts a JOIN pts b ON b.atom_id = a.atom_id + 3"),
    "p1_property_projection": (property_projection, f"WITH {POINTS_SQL} SELECT atom_id, resname, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM pts"),
    "p2_selection": (selection, f"WITH {POINTS_SQL} SELECT atom_id, resid, resname FROM pts WHERE (resid BETWEEN 4 AND 30 OR resname IN ('R07', 'R11')) AND NOT resname IN ('R05')"),
    "p5_type_predicates": (type_predicates, f"WITH {POINTS_SQL}, t AS (SELECT atom_id, (atom_id * 37) % 131072 AS t FROM pts) SELECT atom_id, (t & 2) <> 0 AS donor, (t & 3) = 3 AS \"both\", t = 0 AS \"none\", bit_count(t)::BIGINT AS n_types, bit_count(t)::BIGINT AS n_names FROM t"),
    "p7_neighbour_filters": (ns_filters, f"WITH {PAIRS_SQL} SELECT i, j, round(d2, 6) AS d2 FROM prs WHERE d2 <= 16.0 AND (ca = '3' OR cb = '3')"),
    "p8_residues": (residue_table, f"WITH {POINTS_SQL}, g AS (SELECT chain, resid, resname, min(atom_id) AS f, count(*) AS n_atoms FROM pts GROUP BY 1, 2, 3) SELECT row_number() OVER (ORDER BY f) - 1 AS res_idx, chain, resid, resname, n_atoms FROM g"),
    "p9_residue_classes": (residue_classes, f"WITH {POINTS_SQL} SELECT CASE atom_id % 5 WHEN 0 THEN 'protein' WHEN 1 THEN 'water' WHEN 2 THEN 'base' WHEN 3 THEN 'other' ELSE 'protein' END AS class, count(*) AS n FROM pts GROUP BY 1"),
    "p10_factorize": (factorized, f"WITH {POINTS_SQL}, f AS (SELECT chain, resname, min(atom_id) AS f FROM pts GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY f) - 1 AS factor FROM f) SELECT atom_id, pts.chain, factor FROM pts JOIN n USING (chain, resname)"),
    "s15_subset": (subset, f"WITH {PAIRS_SQL}, k AS (SELECT atom_id, row_number() OVER (ORDER BY atom_id) - 1 AS n FROM pts WHERE chain = '2') SELECT a.n AS a, b.n AS b FROM prs JOIN k a ON a.atom_id = i JOIN k b ON b.atom_id = j"),
    "entity_ids": (entity_ids, f"WITH {POINTS_SQL} SELECT atom_id, ((atom_id % 3) << 56) | atom_id AS eid, CASE atom_id % 3 WHEN 0 THEN 'atom' WHEN 1 THEN 'ring' ELSE 'group' END AS kind, atom_id AS idx FROM pts"),
    "top2_neighbours": (nearest_top2, f"WITH {POINTS_SQL}, bth AS (SELECT a.atom_id AS i, b.atom_id AS j, {D2} AS d2 FROM pts a JOIN pts b ON a.atom_id <> b.atom_id WHERE {D2} <= 100.0), r AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS rank FROM bth) SELECT i, j, rank FROM r WHERE rank <= 2"),
}
