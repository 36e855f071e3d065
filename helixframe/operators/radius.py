"""Fixed-radius joins as grid equi-joins.

Space is cut into cubes at least as wide as the radius; a point meets the 27 cubes around its own. One side
carries the offsets, so the join is an equi-join on (model, cube) that Spark can hash, sort, broadcast,
spill or split, and a large model spreads over its cubes. The distance test is the join's residual. A self join needs
only the cube itself and the 13 after it: of two cubes one comes before the other.

A cube's number is its three coordinates side by side, 21 bits each. Cubes 2^21 apart share a number, which the distance
test undoes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.geometry import distance_sq, vec
from helixframe.operators.kernels import SQUARE, TILE, squared, whole_groups

ALL = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
HALF = [o for o in ALL if o >= (0, 0, 0)]
_BITS = 21
BRUTE_POINTS = 50_000
CHUNKS = 16  # chunks of points in a nested loop
FEW_PAIRS = 5000


def _packed(cells: list[Column]) -> Column:
    part = lambda c, k: F.shiftleft(c.bitwiseAND(F.lit((1 << _BITS) - 1)), k * _BITS)
    return part(cells[0], 2).bitwiseOR(part(cells[1], 1)).bitwiseOR(part(cells[2], 0))


def _cells(width: float) -> list[Column]:
    return [F.floor(F.col(a) / F.lit(width)).cast("long") for a in "xyz"]


def _check(radius: float) -> float:
    if not (radius > 0) or radius == float("inf"):
        raise ValueError("the radius must be finite and above zero")
    return float(radius)


def keyed_by(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with __key, one number for the columns: joins shuffle and sort by it alone."""
    return df.withColumn("__key", F.xxhash64(*columns))


def same_key(columns: list[str], residual: Column | None = None, left: str = "a", right: str = "b") -> Column:
    """The join condition of two sides from `keyed_by`: equal numbers, then equal columns.

    The columns are compared within a CASE, so that Spark doesn't make them join keys of their own.
    """
    equal = F.lit(True) if residual is None else residual
    for name in columns:
        equal = (F.col(f"{left}.{name}") == F.col(f"{right}.{name}")) & equal
    return (F.col(f"{left}.__key") == F.col(f"{right}.__key")) & F.when(equal, F.lit(True)).otherwise(F.lit(False))


def unsent(df: DataFrame) -> DataFrame:
    """df as a side of a join that Spark sorts: a table that grows with the input must not go to the driver because its files are small.

    Files say little: columns that repeat are a hundred times smaller there than as rows.
    """
    return df.hint("merge")


def _joined(left: DataFrame, right: DataFrame, radius: float, model: list[str], residual: Column | None, offsets: list[tuple]) -> DataFrame:
    r = _check(radius)
    moved = F.array(*[F.struct(F.lit(o != (0, 0, 0)).alias("moved"), _packed([c + F.lit(k) for c, k in zip(_cells(r), o, strict=True)]).alias("cube")) for o in offsets])
    around = left.withColumn("__o", F.explode(moved))
    keyed = lambda df: keyed_by(df, [*model, "__cube"])
    a = keyed(around.withColumns({"__cube": F.col("__o.cube"), "__moved": F.col("__o.moved")}).drop("__o")).alias("a")
    b = keyed(right.withColumn("__cube", _packed(_cells(r)))).alias("b")
    d2 = distance_sq(vec("a.x", "a.y", "a.z"), vec("b.x", "b.y", "b.z"))
    near = d2 <= r * r
    return a.join(unsent(b), same_key([*model, "__cube"], near if residual is None else near & residual)).withColumn("distance_sq", d2)


def self_join(points: DataFrame, radius: float, model: list[str] | None = None, key: str = "atom_id", residual: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Unordered pairs within the radius (inclusive), once each: model, i < j, distance_sq.

    residual may refer to the two points as a.* and b.* and must not depend on which is which; keep names further
    columns, returned as <name>_i, <name>_j.
    """
    model, keep = model or [], keep or []
    first = F.col(f"a.{key}") < F.col(f"b.{key}")
    order = first | F.col("a.__moved")
    found = _joined(points, points, radius, model, order if residual is None else order & residual, HALF)
    pick = lambda c, a, b: F.when(first, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}"))
    more = [pick(c, *sides).alias(f"{c}_{o}") for c in keep for sides, o in ((("a", "b"), "i"), (("b", "a"), "j"))]
    return found.select(*[F.col(f"a.{m}") for m in model], pick(key, "a", "b").alias("i"), pick(key, "b", "a").alias("j"), "distance_sq", *more)


def cross_join(query: DataFrame, target: DataFrame, radius: float, model: list[str] | None = None, key: str = "atom_id", residual: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """All (query, target) pairs within the radius, coincident points included."""
    model, keep = model or [], keep or []
    found = _joined(query, target, radius, model, residual, ALL)
    more = [F.col(f"{s}.{c}").alias(f"{c}_{o}") for c in keep for s, o in (("a", "i"), ("b", "j"))]
    return found.select(*[F.col(f"a.{m}") for m in model], F.col(f"a.{key}").alias("i"), F.col(f"b.{key}").alias("j"), "distance_sq", *more)


def brute_force(points: DataFrame, radius: float, key: str = "atom_id") -> DataFrame:
    """The nested-loop form of self_join, for small inputs and as its check; more than BRUTE_POINTS points are refused; `nested_loop` takes any number."""
    n = points.limit(BRUTE_POINTS + 1).count()
    if n > BRUTE_POINTS:
        raise ValueError(f"more than {BRUTE_POINTS} points: use self_join")
    a, b = points.alias("a"), points.alias("b")
    d2 = distance_sq(vec("a.x", "a.y", "a.z"), vec("b.x", "b.y", "b.z"))
    return a.join(b, (F.col(f"a.{key}") < F.col(f"b.{key}")) & (d2 <= radius * radius)).select(F.col(f"a.{key}").alias("i"), F.col(f"b.{key}").alias("j"), d2.alias("distance_sq"))


def _looped(batches: Iterator, radius: float) -> Iterator:
    room = np.empty(SQUARE), np.empty(SQUARE)
    for table, group in whole_groups(batches, ["__pair"]):
        column = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)  # noqa: B023, E731
        ids, chunk, pair, xyz = column("id"), column("__chunk"), column("__pair"), [column(c) for c in "xyz"]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for start, end in zip(starts, np.r_[starts[1:], len(group)], strict=True):
            first = chunk[start:end] == pair[start] // CHUNKS
            one = pair[start] // CHUNKS == pair[start] % CHUNKS
            a, b = start + np.flatnonzero(first), start + np.flatnonzero(first if one else ~first)
            for p in range(0, len(a), SQUARE // TILE):
                for q in range(0, len(b), TILE):
                    x, y = a[p : p + SQUARE // TILE], b[q : q + TILE]
                    d2 = squared([c[x] for c in xyz], [c[y] for c in xyz], *room).ravel()
                    hit = np.flatnonzero(d2 <= radius * radius)
                    i, j, near = hit // len(y), hit % len(y), d2[hit]
                    i, j = ids[x[i]], ids[y[j]]
                    keep = i < j if one else i != j
                    if keep.any():
                        i, j, near = i[keep], j[keep], near[keep]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(near)], ["i", "j", "distance_sq"])


def nested_loop(points: DataFrame, radius: float, key: str = "atom_id") -> DataFrame:
    """What brute_force gives for long ids, however many the points are: all pairs are compared, chunk by chunk of points.

    Points are dealt to CHUNKS chunks by their id and sent to each pair of chunks that theirs is in, so a point moves CHUNKS
    times and a task holds two chunks. The work is quadratic, as it is meant to be.
    """
    r = _check(radius)
    rows = points.select(F.col(key).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    dealt = rows.withColumn("__chunk", F.pmod(F.xxhash64("id"), F.lit(CHUNKS))).withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1))))
    paired = dealt.select("id", "x", "y", "z", "__chunk", (F.least("__chunk", "__other") * CHUNKS + F.greatest("__chunk", "__other")).alias("__pair"))
    spark = points.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # few bytes, much work: not merged
    return paired.repartition(parts, "__pair").sortWithinPartitions("__pair").mapInArrow(lambda b: _looped(b, r), "i long, j long, distance_sq double")


def neighbour_lists(pairs: DataFrame, sort: bool = True) -> DataFrame:
    """(i, neighbours array<struct<d, j>>) of both directions of self pairs; sorted by distance, then id."""
    both = pairs.select("i", "j", "distance_sq").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "distance_sq"))
    found = F.collect_list(F.struct(F.sqrt("distance_sq").alias("d"), "j"))
    return both.groupBy("i").agg((F.array_sort(found) if sort else found).alias("neighbours"))


class Neighbours:
    """Neighbours within a radius of fitted points: of the points themselves, never their own, or of other queries."""

    def __init__(self, radius: float, model: list[str] | None = None, key: str = "atom_id"):
        self.radius, self.model, self.key = _check(radius), model or [], key

    def fit(self, points: DataFrame) -> Neighbours:
        self.points = points
        return self

    def query(self, queries: DataFrame | None = None, sort: bool = True) -> DataFrame:
        """(i, neighbours array<struct<d, j>>) of every query that has some."""
        if queries is None:
            return neighbour_lists(self_join(self.points, self.radius, self.model, self.key), sort)
        pairs = cross_join(queries, self.points, self.radius, self.model, self.key)
        found = F.collect_list(F.struct(F.sqrt("distance_sq").alias("d"), "j"))
        return pairs.groupBy("i").agg((F.array_sort(found) if sort else found).alias("neighbours"))


def pairs_within(points: DataFrame, radius: float, key: str = "atom_id") -> DataFrame:
    """Pairs i < j within the radius: the nested loop where at most FEW_PAIRS candidate pairs exist, else the grid."""
    n = points.limit(int((2 * FEW_PAIRS) ** 0.5) + 2).count()
    return brute_force(points, radius, key) if n * (n - 1) // 2 <= FEW_PAIRS else self_join(points, radius, key=key)


def _cuts(df: DataFrame, order: str, parts: int) -> Column:
    """The range of a row's key among quantile cuts that travel as a literal."""
    probes = [i / parts for i in range(1, parts)] or [0.5]
    cuts = df.agg(F.percentile_approx(order, probes, 10_000)).first()[0] or []
    return F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))] or [F.lit(0).cast("long")]), lambda c: c < F.col(order)))


def offsets(counts: DataFrame, order: str, n: str, parts: int = 64) -> DataFrame:
    """counts with indptr, the sum of n over all smaller keys, without one task that sorts everything.

    Rows are cut into ranges of the key; sums run within a range, and the sums of the ranges before, one row
    a range, are added.
    """
    cut = counts.withColumn("__part", _cuts(counts, order, parts))
    sums = cut.groupBy("__part").agg(F.sum(n).alias("__sum"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    starts = sums.select("__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    local = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn("__local", F.coalesce(F.sum(n).over(local), F.lit(0)))
    return summed.join(F.broadcast(starts), "__part").select(*counts.columns, (F.col("__start") + F.col("__local")).cast("long").alias("indptr"))


def renumber(rows: DataFrame, order: str, name: str = "new_id") -> DataFrame:
    """rows numbered from 0 in order of a unique key."""
    return offsets(rows.withColumn("__one", F.lit(1)), order, "__one").drop("__one").withColumnRenamed("indptr", name)
