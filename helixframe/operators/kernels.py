"""What numpy kernels over Arrow batches share: whole groups from a sorted stream, and neighbour pairs on a grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FULL = 10_000  # points of a block of space; where there are more, blocks are narrower
CROWDED = 100  # points of a cube from which on cubes are halved and worked on one by one
CANDIDATES, SQUARE, TILE, TOGETHER = 1 << 20, 1 << 16, 1 << 10, 1 << 17  # candidate pairs looked at together, of many places or of one cube; points of those; pairs handed on together


def group_numbers(table, keys: list[str]) -> np.ndarray:
    """A number per row that grows by one where a key changes; rows of a group stand together."""
    change = np.zeros(table.num_rows, dtype=bool)
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(change)


def whole_groups(batches: Iterator, keys: list[str], most: int = 1 << 16) -> Iterator:
    """(table, group number of each row): tables of some `most` rows that hold whole groups of a stream sorted by the keys; a larger group comes alone."""
    import pyarrow as pa

    held, rows, enough = [], 0, most
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        table = pa.Table.from_batches(held)
        numbers = group_numbers(table, keys)
        cut = int(np.searchsorted(numbers, numbers[-1]))
        if cut:
            yield table.slice(0, cut), numbers[:cut]
        rest = table.slice(cut)
        held, rows = rest.to_batches(), rest.num_rows
        enough = max(most, 2 * rows)  # a large group isn't looked through at every batch
    if rows:
        table = pa.Table.from_batches(held)
        yield table, group_numbers(table, keys)


def block_width(rows, keys: list[str], halo: float, width: float, most: int = FULL) -> float:
    """width, or 2 * halo or halo where blocks that wide would hold more than `most` points: a crowded box is many blocks too."""
    from pyspark.sql import functions as F

    for wide in (max(width, 2 * halo), 2 * halo):
        cells = rows.groupBy(*keys, *[F.floor(F.col(c) / wide).alias(f"b{c}") for c in "xyz"]).count()
        if (cells.agg(F.max("count")).first()[0] or 0) <= most:
            return wide
    return halo


def in_blocks(rows, keys: list[str], halo: float, width: float, reached=None):
    """rows dealt to blocks of space, each with the points within `halo` around it: adds block and own (whether the block is the point's own).

    reached tells which rows other blocks need (by default all). Sorted by keys, block and atom_id within partitions, ready for
    `whole_groups`. Where blocks are narrow, the points are crowded and few bytes are much work: their partitions aren't merged.
    """
    from pyspark.sql import functions as F

    wide, halo = max(width, halo), halo * (1 + 1e-6)  # rounding must not lose a point at the very reach
    of = lambda c, by: F.floor((F.col(c) + by) / wide).cast("long")
    spread = rows
    for c in "xyz":
        by = F.lit(halo) if reached is None else F.when(reached, halo).otherwise(0.0)
        spread = spread.withColumn(f"b{c}", F.explode(F.sequence(of(c, -by), of(c, by))))
    own = (F.col("bx") == of("x", 0)) & (F.col("by") == of("y", 0)) & (F.col("bz") == of("z", 0))
    dealt = spread.select(*rows.columns, F.concat_ws(",", "bx", "by", "bz").alias("block"), own.alias("own"))
    spark = rows.sparkSession
    parts = [] if width >= 2.5 * halo else [max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)]
    return dealt.repartition(*parts, *keys, "block").sortWithinPartitions(*keys, "block", "atom_id")


def finite():
    """Whether a row of points has finite coordinates; others are near nothing."""
    from pyspark.sql import functions as F

    test = F.lit(True)
    for c in "xyz":
        test = test & (F.abs(F.col(c)) < float("inf"))  # NaN counts as more than infinity
    return test


def squared(a, b, room: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Squared distances of all points a (3 arrays) to all points b, in room that stays in the processor's cache."""
    shape = len(a[0]), len(b[0])
    d2, v = (x[: shape[0] * shape[1]].reshape(shape) for x in (room, more))
    np.subtract(a[0][:, None], b[0], out=d2)
    np.multiply(d2, d2, out=d2)
    for k in (1, 2):
        np.subtract(a[k][:, None], b[k], out=v)
        np.multiply(v, v, out=v)
        np.add(d2, v, out=d2)
    return d2


class Grid:
    """Points of several groups in cubes, sorted by group and cube; crowded points have cubes half as wide as the reach, others as wide.

    Rows of a group stand together. Neighbours come in bounded parts, however crowded the points are.
    """

    def __init__(self, xyz: np.ndarray, group: np.ndarray, reach: float, groups: int = 0):
        self.xyz, self.group, self.reach = xyz, group, reach
        self.low = np.zeros((max(groups, int(group.max()) + 1 if len(group) else 0), 3))
        if len(group):
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            self.low[group[first]] = np.minimum.reduceat(xyz, first, axis=0)
        self._fit(group, 1)
        self.crowded = len(xyz) > CROWDED * max(1, np.count_nonzero(np.diff(self.sorted)) + 1)
        if self.crowded:
            self._fit(group, 2)
        self.columns = [(a, b) for a in range(-self.fine, self.fine + 1) for b in range(-self.fine, self.fine + 1)]

    def _fit(self, group: np.ndarray, fine: int) -> None:
        self.fine, self.pad, self.width = fine, 2 * fine + 1, self.reach * (1 + 1e-9) / fine  # rounding must not lose a point at the very reach
        cells = self._cells(self.xyz, group)
        self.wide = (cells.max(axis=0) if len(cells) else np.zeros(3, dtype=np.int64)) + self.pad + 1
        key = self._keys(cells, group)
        self.order = np.argsort(key, kind="stable")
        self.sorted = key[self.order]
        self.places = np.ascontiguousarray(self.xyz[self.order].T)

    def _cells(self, xyz: np.ndarray, group: np.ndarray) -> np.ndarray:
        return np.floor((xyz - self.low[group]) / self.width).astype(np.int64) + self.pad

    def _keys(self, cells: np.ndarray, group: np.ndarray) -> np.ndarray:
        return ((group.astype(np.int64) * self.wide[0] + cells[:, 0]) * self.wide[1] + cells[:, 1]) * self.wide[2] + cells[:, 2]

    def _queries(self, xyz: np.ndarray, group: np.ndarray) -> np.ndarray:
        cells = self._cells(xyz, group)
        return self._keys(np.clip(cells, self.fine, self.wide - 1 - self.fine), group)  # beyond the points there is nothing

    def runs(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) in sorted order of the points in the cubes around each key, by column of cubes."""
        middle = [key + (a * self.wide[1] + b) * self.wide[2] for a, b in self.columns]
        low = np.stack([np.searchsorted(self.sorted, m - self.fine, side="left") for m in middle])
        return low, np.stack([np.searchsorted(self.sorted, m + self.fine, side="right") for m in middle])

    def counts(self, xyz: np.ndarray, group: np.ndarray) -> np.ndarray:
        """How many points are in the cubes around each place."""
        low, high = self.runs(self._queries(xyz, group))
        return (high - low).sum(axis=0)

    def near(self, xyz: np.ndarray, group: np.ndarray, skip: np.ndarray | None = None, together: int = TOGETHER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, point, squared distance) of all points of a place's group within reach, in parts of some `together` rows; skip is a point that doesn't count, by place."""
        held, size = [], 0
        key = self._queries(xyz, group)
        for at, target, d2 in self._by_cube(xyz, key) if self.crowded else self._by_place(xyz, key):
            if skip is not None:
                keep = target != skip[at]
                at, target, d2 = at[keep], target[keep], d2[keep]
            if not len(at):
                continue
            held.append((at, target, d2))
            size += len(at)
            if size >= together:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))

    def _by_place(self, xyz: np.ndarray, key: np.ndarray) -> Iterator:
        low, high = self.runs(key)
        ends = np.cumsum((high - low).sum(axis=0))
        start = 0
        while start < len(key):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CANDIDATES, side="right")))
            first, n = low[:, start:stop].ravel(), (high - low)[:, start:stop].ravel()
            at = np.repeat(np.tile(np.arange(start, stop), len(low)), n)
            place = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            x, y, z = (self.places[k][place] - xyz[at, k] for k in range(3))
            d2 = x * x + y * y + z * z
            keep = d2 <= self.reach * self.reach
            yield at[keep], self.order[place[keep]], d2[keep]
            start = stop

    def _by_cube(self, xyz: np.ndarray, key: np.ndarray) -> Iterator:
        if not len(key):
            return
        by = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
        room = np.empty(SQUARE), np.empty(SQUARE)
        low, high = self.runs(key[by[heads]])
        for c, (head, end) in enumerate(zip(heads, np.r_[heads[1:], len(by)], strict=True)):
            spans = [(i, j) for i, j in zip(low[:, c], high[:, c], strict=True) if j > i]
            if not spans:
                continue
            around = np.concatenate([self.places[:, i:j] for i, j in spans], axis=1)
            points = np.concatenate([self.order[i:j] for i, j in spans])
            for start in range(0, len(points), TILE):
                part = around[:, start : start + TILE]
                m = part.shape[1]
                step = max(1, SQUARE // m)
                for first in range(head, end, step):
                    who = by[first : min(first + step, end)]
                    d2 = squared(xyz[who].T, part, *room)
                    hit = np.flatnonzero(d2.ravel() <= self.reach * self.reach)
                    yield who[hit // m], points[start + hit % m], d2.ravel()[hit]

    def pairs(self, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, squared distance) of all pairs i of `who`, j any other point of its group within reach; by i as in `who`."""
        found = list(self.near(self.xyz[who], self.group[who], who))
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        index, target, d2 = map(np.concatenate, zip(*found, strict=True))
        by = np.argsort(index, kind="stable")
        return index[by], target[by], d2[by]
