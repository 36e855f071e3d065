"""What templates don't cover: ring search in ligands, planarity, angles at rings, other typing of typed atoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.geometry import acute, centroid, cross, dot, let, norm, ring_normal, sub, vector_angle
from helixframe.operators import topology as topo

# Ring sizes that can be aromatic, and how far a planar ring may bend (Angstrom, radians).
SIZES, FLAT, BENT = (5, 6), 0.05, 0.05


def smallest_moment(points: Column) -> Column:
    """The smallest eigenvalue of the points' covariance sums about their mean, in closed form."""

    def about(e: Column) -> Column:
        total = lambda f: F.aggregate(e["p"], F.lit(0.0), lambda s, p: s + f(p))
        sums = F.struct(*[total(lambda p, a=a, b=b: (p[a] - e["c"][a]) * (p[b] - e["c"][b])).alias(a + b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")])
        return let(sums, eigen)

    def eigen(m: Column) -> Column:
        q = (m["xx"] + m["yy"] + m["zz"]) / 3
        spread = (m["xx"] - q) ** 2 + (m["yy"] - q) ** 2 + (m["zz"] - q) ** 2 + 2 * (m["xy"] ** 2 + m["xz"] ** 2 + m["yz"] ** 2)
        return let(F.struct(m.alias("m"), q.alias("q"), F.sqrt(spread / 6).alias("p")), third)

    def third(e: Column) -> Column:
        m, q, p = e["m"], e["q"], F.nullif(e["p"], F.lit(0.0))
        a, b, c = ((m[k] - q) / p for k in ("xx", "yy", "zz"))
        d, f, g = (m[k] / p for k in ("xy", "xz", "yz"))
        half = (a * (b * c - g * g) - d * (d * c - g * f) + f * (d * g - b * f)) / 2
        turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3 + 2.0943951023931953
        return F.when(p.isNull(), q).otherwise(q + 2 * p * F.cos(turn))

    return let(F.struct(points.alias("p"), centroid(points).alias("c")), about)


def is_planar(points: Column) -> Column:
    """Whether a ring's atoms lie in a plane: their smallest axis, or the mean angle between the normals of consecutive atom pairs, is small."""

    def mean_turn(e: Column) -> Column:
        n = F.size(e["p"])
        at = lambda i: sub(F.get(e["p"], i % n), e["c"])
        normals = F.transform(F.sequence(F.lit(0), n - 1), lambda i: cross(at(i), at(i + 1)))
        turns = let(normals, lambda v: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.radians(vector_angle(F.get(v, i), F.get(v, (i + 1) % n)))))
        return F.aggregate(turns, F.lit(0.0), lambda s, t: s + t) / n

    thin = F.sqrt(F.greatest(F.lit(0.0), smallest_moment(points)) / (F.size(points) / 3.0)) < FLAT
    return F.coalesce(thin | (let(F.struct(points.alias("p"), centroid(points).alias("c")), mean_turn) < BENT), F.lit(False))


def find_rings(nodes: DataFrame, model: list[str], sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(model, atom_ids) of the rings without chords of a graph given as nodes (model, atom_id, ids of neighbours).

    Paths grow by one equi-join a step from their smallest atom; a ring is met once, in the direction of its smaller
    second atom. Atoms have few neighbours, so the paths of an atom are few, whatever the graph's size.
    """
    path = nodes.select(*model, F.array("atom_id").alias("path"), F.array("ids").alias("lists"), F.col("ids").alias("last_ids"))
    found = None
    for size in range(2, max(sizes) + 1):
        step = path.withColumn("next", F.explode("last_ids")).where(~F.array_contains("path", F.col("next")) & (F.col("next") > F.col("path")[0])).drop("last_ids")
        met = topo.attach(step, nodes.select(*model, F.col("atom_id").alias("next"), F.col("ids").alias("last_ids")), [*model, "next"], "inner")
        path = met.select(*model, F.array_append("path", F.col("next")).alias("path"), F.array_append("lists", F.col("last_ids")).alias("lists"), "last_ids")
        if size in sizes:
            inside = F.aggregate("lists", F.lit(0), lambda s, ids: s + F.size(F.array_intersect(ids, F.col("path"))))
            closed = path.where(F.array_contains("last_ids", F.col("path")[0]) & (F.col("path")[1] < F.col("path")[size - 1]) & (inside == 2 * size)).select(*model, F.col("path").alias("atom_ids"))
            found = closed if found is None else found.unionByName(closed)
    return found


def ligand_rings(feature: DataFrame, model: list[str] = topo.MODEL, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(model, residue, ring_no, atom_ids, center, normal) of planar rings in residues without a template; feature has nbrs."""
    other = feature.where((F.col("rclass") == "other") & (F.size("nbrs") >= 2)).select(*model, *topo.RESIDUE, "atom_id", "el", F.transform("nbrs", lambda n: n["atom_id"]).alias("ids"), F.struct("x", "y", "z").alias("p"))
    rings = find_rings(other.where(F.col("el").isin("C", "N", "O", "S", "P", "B", "SE")).select(*model, "atom_id", "ids"), model, sizes)
    parts = rings.select(*model, "atom_ids", F.posexplode("atom_ids").alias("place", "atom_id"))
    met = topo.attach(parts, other.select(*model, "atom_id", *topo.RESIDUE, "p"), [*model, "atom_id"], "inner")
    whole = met.groupBy(*model, "atom_ids").agg(F.min_by(F.struct(*topo.RESIDUE), "place").alias("r"), F.array_sort(F.collect_list(F.struct("place", "p"))).alias("parts"))
    measured = whole.select(*model, "r.*", "atom_ids", F.transform("parts", lambda t: t["p"]).alias("points")).where(is_planar(F.col("points")))
    return measured.select(*model, *topo.RESIDUE, F.lit(0).alias("ring_no"), "atom_ids", centroid(F.col("points")).alias("center"), ring_normal(F.col("points")).alias("normal"))


def ring_angles(rings: DataFrame, points: DataFrame, model: list[str] = topo.MODEL) -> DataFrame:
    """points (model, ring_id, x, y, z) with angle: degrees between a ring's normal and the way from its centre to the point, 0 for a ring that doesn't exist."""
    met = topo.attach(points, rings.select(*model, "ring_id", "center", "normal"), [*model, "ring_id"])
    to = sub(F.struct("x", "y", "z"), F.col("center"))
    return met.select(*points.columns, F.when(F.col("center").isNull(), 0.0).otherwise(F.coalesce(vector_angle(to, F.col("normal")), F.lit(0.0))).alias("angle"))


def acute_ring_angles(rings: DataFrame, points: DataFrame, model: list[str] = topo.MODEL) -> DataFrame:
    """ring_angles folded to at most 90 degrees, whichever side of the ring the point is on."""
    return ring_angles(rings, points, model).withColumn("angle", acute(F.col("angle")))


def retype(typed: DataFrame, provider: str) -> DataFrame:
    """Typed atoms with the types of another catalogue; bonds and features stay as they are."""
    types = {"molstar": topo.molstar_types, "arpeggio": topo.arpeggio_types, "getcontacts": topo.getcontacts_types}
    if provider not in types:
        raise ValueError(f"one of {', '.join(types)}")
    return types[provider](typed.drop("atom_type"))


def height(point: Column, ring: Column) -> Column:
    """Distance of a point from a ring's plane."""
    return F.abs(dot(sub(point, ring["center"]), ring["normal"])) / F.nullif(norm(ring["normal"]), F.lit(0.0))
