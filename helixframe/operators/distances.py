"""Distance matrices in long form, periodic distances and indexed distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.geometry import add, distance_sq, dot, let, sub, vec


def _pairs(left: DataFrame, right: DataFrame, model: list[str], key: str, order: Column | None, squared: bool) -> DataFrame:
    on = F.lit(True)
    for m in model:
        on = on & (F.col(f"a.{m}") == F.col(f"b.{m}"))
    if order is not None:
        on = on & order
    d2 = distance_sq(vec("a.x", "a.y", "a.z"), vec("b.x", "b.y", "b.z"))
    met = left.alias("a").join(right.alias("b"), on)
    return met.select(*[F.col(f"a.{m}") for m in model], F.col(f"a.{key}").alias("i"), F.col(f"b.{key}").alias("j"), (d2 if squared else F.sqrt(d2)).alias("d"))


def cdist(left: DataFrame, right: DataFrame, model: list[str] | None = None, key: str = "atom_id", squared: bool = False) -> DataFrame:
    """(i, j, d) of every pair across two point sets, within each model. The result has n * m rows by definition."""
    return _pairs(left, right, model or [], key, None, squared)


def pdist(points: DataFrame, model: list[str] | None = None, key: str = "atom_id", squared: bool = False) -> DataFrame:
    """The condensed form: pairs i < j once."""
    return _pairs(points, points, model or [], key, F.col(f"a.{key}") < F.col(f"b.{key}"), squared)


def pairwise(points: DataFrame, model: list[str] | None = None, key: str = "atom_id", squared: bool = False) -> DataFrame:
    """The square form with its zero diagonal."""
    return _pairs(points, points, model or [], key, None, squared)


def point_distance(a: Column, b: Column) -> Column:
    return F.sqrt(distance_sq(a, b))


def minimum_image(d: Column, box: tuple[float, float, float]) -> Column:
    """A displacement in an orthorhombic periodic box, folded to its shortest image."""
    fold = lambda v, size: v - F.lit(size) * F.round(v / F.lit(size)) if size > 0 else v
    return vec(fold(d["x"], box[0]), fold(d["y"], box[1]), fold(d["z"], box[2]))


def periodic_distance(a: Column, b: Column, box: tuple[float, float, float]) -> Column:
    d = minimum_image(sub(a, b), box)
    return F.sqrt(dot(d, d))


def triclinic_distance(a: Column, b: Column, box: tuple[tuple[float, float, float], ...]) -> Column:
    """Minimum image in a triclinic box with lower triangular rows (a along x, b in the xy plane, c).

    The displacement is folded along c, b, a in turn, then the 27 images around it are compared.
    """
    (ax, _, _), (bx, by, _), (cx, cy, cz) = box
    fold = lambda x, y, z: lambda d: vec(d["x"] - F.round(d[z] / x) * y[0], d["y"] - F.round(d[z] / x) * y[1], d["z"] - F.round(d[z] / x) * y[2])
    along_c, along_b, along_a = fold(cz, (cx, cy, cz), "z"), fold(by, (bx, by, 0.0), "y"), fold(ax, (ax, 0.0, 0.0), "x")
    moves = [(i * ax + j * bx + k * cx, j * by + k * cy, k * cz) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    images = F.array(*[vec(*map(F.lit, m)) for m in moves])
    shortest = lambda d: F.array_min(F.transform(images, lambda m: let(add(d, m), lambda e: dot(e, e))))
    return F.sqrt(let(let(let(let(sub(a, b), along_c), along_b), along_a), shortest))


def indexed_distances(pairs: DataFrame, points: DataFrame, model: list[str] | None = None, key: str = "atom_id") -> DataFrame:
    """Distances of given (i, j) pairs by two equi-joins."""
    model = model or []
    out = pairs
    for side in ("i", "j"):
        out = out.join(points.select(*model, F.col(key).alias(side), vec("x", "y", "z").alias(f"__{side}")), [*model, side])
    return out.withColumn("d", point_distance(F.col("__i"), F.col("__j"))).drop("__i", "__j")


def within(pairs: DataFrame, radius: float) -> DataFrame:
    """Neighbour pairs no farther than the radius."""
    return pairs.where(F.col("distance_sq") <= float(radius) * float(radius))


def touching(pairs: DataFrame, indices: DataFrame, column: int | None = None) -> DataFrame:
    """Neighbour pairs with an index on either side, or on side 0 or 1 only."""
    if column not in (None, 0, 1):
        raise ValueError("column must be 0 or 1")
    ids = indices.select(F.col(indices.columns[0]).alias("__index")).distinct()
    if column is not None:
        return pairs.join(ids, F.col("ij"[column]) == F.col("__index"), "left_semi")
    first = pairs.join(ids, F.col("i") == F.col("__index"), "left_semi")
    rest = pairs.join(ids, F.col("i") == F.col("__index"), "left_anti")
    return first.unionByName(rest.join(ids, F.col("j") == F.col("__index"), "left_semi"))


def tiles(points: DataFrame, key: str, size: int) -> DataFrame:
    """(row_block, col_block, n_pairs) of the upper triangle of blocks of `size` keys, diagonal included."""
    blocks = points.groupBy(F.floor(F.col(key) / size).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    a, c = blocks.alias("a"), blocks.alias("c")
    own = (F.col("a.n") * (F.col("a.n") - 1) / 2).cast("long")
    return a.join(c, F.col("a.b") <= F.col("c.b")).select(F.col("a.b").alias("row_block"), F.col("c.b").alias("col_block"), F.when(F.col("a.b") == F.col("c.b"), own).otherwise(F.col("a.n") * F.col("c.n")).cast("long").alias("n_pairs"))


def matrix_blocks(left: DataFrame, right: DataFrame, columns: int = 8192, key: str = "atom_id", squared: bool = False) -> DataFrame:
    """(i, block, first_j, d): the rows of a distance matrix in blocks of `columns` columns, d holding a block's distances in order of j.

    Columns are numbered by their key's rank; a block is what one row of the result holds, so no row grows with the matrix.
    """
    from helixframe.operators.radius import renumber

    ranked = renumber(right.select(F.col(key).alias("__j"), "x", "y", "z"), "__j", "__column")
    blocks = ranked.groupBy(F.floor(F.col("__column") / columns).alias("block")).agg(F.array_sort(F.collect_list(F.struct("__column", "__j", F.struct("x", "y", "z").alias("p")))).alias("points"))
    away = lambda t: distance_sq(vec("x", "y", "z"), t["p"]) if squared else F.sqrt(distance_sq(vec("x", "y", "z"), t["p"]))
    met = left.select(F.col(key).alias("i"), "x", "y", "z").crossJoin(blocks)  # every row by every block, which is the result
    return met.select("i", "block", F.col("points")[0]["__j"].alias("first_j"), F.transform("points", away).alias("d"))


def tiles_across(queries: DataFrame, targets: DataFrame, key: str, rows: int, columns: int) -> DataFrame:
    """(row_block, col_block, n_pairs) of all blocks of `rows` queries by `columns` targets."""
    count = lambda df, size: df.groupBy(F.floor(F.col(key) / size).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    a, c = count(queries, rows).alias("a"), count(targets, columns).alias("c")
    return a.crossJoin(c).select(F.col("a.b").alias("row_block"), F.col("c.b").alias("col_block"), (F.col("a.n") * F.col("c.n")).alias("n_pairs"))  # one narrow row a tile, which is the result
