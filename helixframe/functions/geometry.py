"""Vector geometry as Column expressions over structs with fields x, y, z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(x: Column | str, y: Column | str, z: Column | str) -> Column:
    as_col = lambda v: F.col(v) if isinstance(v, str) else v
    return F.struct(as_col(x).cast("double").alias("x"), as_col(y).cast("double").alias("y"), as_col(z).cast("double").alias("z"))


def sub(a: Column, b: Column) -> Column:
    return vec(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def add(a: Column, b: Column) -> Column:
    return vec(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def scale(a: Column, k: Column | float) -> Column:
    return vec(a["x"] * k, a["y"] * k, a["z"] * k)


def let(value: Column, use) -> Column:
    """use(value) with the value computed once; keeps expressions small where a value is used often."""
    return F.transform(F.array(value), use)[0]


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance_sq(a: Column, b: Column) -> Column:
    d = sub(a, b)
    return dot(d, d)


def _acos_deg(c: Column) -> Column:
    return F.when(c.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))))


def _cos(u: Column, v: Column) -> Column:
    size = F.sqrt(dot(u, u) * dot(v, v))
    return F.when(size > 0, dot(u, v) / F.nullif(size, F.lit(0.0)))


def vector_angle(a: Column, b: Column) -> Column:
    """Degrees between two vectors; null if one of them has no length."""
    return let(F.struct(a.alias("u"), b.alias("v")), lambda e: let(_cos(e["u"], e["v"]), _acos_deg))


def angle(a: Column, b: Column, c: Column) -> Column:
    """Degrees at b."""
    return vector_angle(sub(a, b), sub(c, b))


def dihedral(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Signed torsion angle about the axis b-c, in degrees."""
    edges = F.struct(sub(b, a).alias("p"), sub(c, b).alias("q"), sub(d, c).alias("r"))

    def torsion(e: Column) -> Column:
        normals = F.struct(cross(e["p"], e["q"]).alias("m"), cross(e["q"], e["r"]).alias("n"))
        return let(normals, lambda k: F.degrees(F.atan2(norm(e["q"]) * dot(e["p"], k["n"]), dot(k["m"], k["n"]))))

    return let(edges, torsion)


def acute(angle_deg: Column) -> Column:
    return F.least(angle_deg, F.lit(180.0) - angle_deg)


def plane_offset(point: Column, center: Column, normal: Column) -> Column:
    """Distance of a point from a ring's axis, measured in the ring's plane."""

    def offset(e: Column) -> Column:
        d, n = e["d"], e["n"]
        n2 = dot(n, n)
        along = F.when(n2 > 0, dot(d, n) * dot(d, n) / F.nullif(n2, F.lit(0.0))).otherwise(F.lit(0.0))
        return F.sqrt(F.greatest(F.lit(0.0), dot(d, d) - along))

    return let(F.struct(sub(point, center).alias("d"), normal.alias("n")), offset)


def out_of_plane(origin: Column, first: Column, second: Column, point: Column) -> Column:
    """Degrees by which point leaves the plane of origin, first and second."""
    parts = F.struct(cross(sub(first, origin), sub(second, origin)).alias("n"), sub(point, origin).alias("t"))
    return let(parts, lambda e: F.degrees(F.abs(F.atan2(dot(e["n"], e["t"]), let(cross(e["n"], e["t"]), norm)))))


def centroid(points: Column) -> Column:
    """Mean of an array of points."""
    n = F.size(points).cast("double")
    total = lambda k: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[k])
    return vec(total("x") / n, total("y") / n, total("z") / n)


def ring_normal(points: Column) -> Column:
    """Cross product of the first two edges from the ring's first atom; zero for degenerate rings."""
    edges = F.struct(sub(points[1], points[0]).alias("u"), sub(points[2], points[0]).alias("v"))
    return let(edges, lambda e: cross(e["u"], e["v"]))
