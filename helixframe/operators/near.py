"""Pairs of points within a radius, tested where they are found: blocks of space in, accepted pairs out.

Points move once, with a halo as wide as the radius; pairs are never shuffled. A test sees columns of numpy arrays over many
pairs at once. Null and unknown follow SQL: a test holds only if it is known to hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.kernels import Grid, block_width, finite, in_blocks, whole_groups

BLOCK = 40.0  # width of a block of space


class Columns:
    """Columns of an Arrow table as numpy arrays, converted when asked for; strings are numbers of their values, -1 for null."""

    def __init__(self, table):
        self.table, self.values, self._held = table, {}, {}

    def held(self, name: str, make: Callable):
        if name not in self._held:
            self._held[name] = make()
        return self._held[name]

    def array(self, name: str):
        return self.table.column(name).combine_chunks()

    def __getitem__(self, name: str) -> np.ndarray:
        return self.held(name, lambda: self._read(name))

    def _read(self, name: str) -> np.ndarray:
        import pyarrow as pa

        array = self.array(name)
        if not (pa.types.is_string(array.type) or pa.types.is_large_string(array.type)):
            return array.to_numpy(zero_copy_only=False)
        coded = array.dictionary_encode()
        self.values[name] = np.array(coded.dictionary.to_pylist(), dtype=object)
        return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)

    def mapped(self, name: str, value: Callable, unknown) -> np.ndarray:
        """value of each string, unknown for null."""
        codes = self[name]
        return np.array([*map(value, self.values[name]), unknown])[codes]

    def within(self, name: str, values: tuple, unknown: bool = False) -> np.ndarray:
        return self.held(f"{name} in {values} {unknown}", lambda: self.mapped(name, lambda v: v in values, unknown))


class Side:
    """One side of many pairs."""

    def __init__(self, columns: Columns, rows: np.ndarray):
        self.columns, self.rows = columns, rows

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name][self.rows]

    def within(self, name: str, *values: str) -> np.ndarray:
        return self.columns.within(name, values)[self.rows]

    def outside(self, name: str, *values: str) -> np.ndarray:
        """Known to be none of the values."""
        return ~self.columns.within(name, values, True)[self.rows]

    def at(self, some: np.ndarray) -> Side:
        return Side(self.columns, self.rows[some])

    @property
    def place(self) -> tuple:
        return tuple(self[c] for c in "xyz")


def differ(a: Side, b: Side, name: str) -> np.ndarray:
    """Known to be unequal."""
    x, y = a[name], b[name]
    return (x != y) & ((x >= 0) & (y >= 0) if name in a.columns.values else (x == x) & (y == y))


def near_pairs(rows: DataFrame, reach: float, model: list[str], kinds: tuple[str, ...], classify: Callable, sided: bool = False) -> DataFrame:
    """(model, i, j, type, distance_sq) of pairs within reach (inclusive) that classify accepts.

    rows has model, atom_id, x, y, z and what classify reads. classify(columns, i, j, d2) gives (number of a kind, places of
    accepted pairs) for arrays of row numbers i and j. Pairs have i < j by atom_id; if sided, i has side 0 and j side 1.
    """
    rows = rows.withColumns({c: F.col(c).cast("double") for c in "xyz"}).where(finite())
    width = block_width(rows, model, reach, BLOCK)
    dealt = in_blocks(rows, model, reach, width, F.col("side") == 1 if sided else None)
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in model) + ", " * bool(model) + "i long, j long, kind int, distance_sq double"
    found = dealt.mapInArrow(lambda b: _batches(b, model, reach, classify, sided), schema)
    name: Column = F.element_at(F.array(*map(F.lit, kinds)), F.col("kind") + 1)
    return found.select(*model, "i", "j", name.alias("type"), "distance_sq")


def _batches(batches: Iterator, model: list[str], reach: float, classify: Callable, sided: bool) -> Iterator:
    import pyarrow as pa

    for table, group in whole_groups(batches, [*model, "block"]):
        columns = Columns(table)
        xyz = np.stack([columns[c] for c in "xyz"], axis=1)
        ids, who = columns["atom_id"], np.flatnonzero(columns["own"])
        if sided:
            who, others = who[columns["side"][who] == 0], np.flatnonzero(columns["side"] == 1)
            met = Grid(xyz[others], group[others], reach, int(group[-1]) + 1).near(xyz[who], group[who]) if len(who) and len(others) else ()
        else:
            met = Grid(xyz, group, reach).near(xyz[who], group[who], who) if len(who) else ()
        for at, target, d2 in met:
            i, j = who[at], others[target] if sided else target
            if not sided:
                first = ids[i] < ids[j]
                i, j, d2 = i[first], j[first], d2[first]
            for kind, some in classify(columns, i, j, d2):
                if len(some):
                    keys = [table.column(c).combine_chunks().take(pa.array(i[some])) for c in model]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(ids[i[some]], pa.int64()), pa.array(ids[j[some]], pa.int64()), pa.array(np.full(len(some), kind, dtype=np.int32)), pa.array(d2[some])], [*model, "i", "j", "kind", "distance_sq"])


def nearest(rows: DataFrame, most: int, reach: float, model: list[str]) -> DataFrame:
    """(model, i, j, rank): the `most` nearest other points within reach (inclusive), by distance, then id; rank from 1. No pair but these leaves its task."""
    part = rows.select(*model, F.col("atom_id").cast("long").alias("atom_id"), *[F.col(c).cast("double").alias(c) for c in "xyz"]).where(finite())
    types = dict(part.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in model) + ", " * bool(model) + "i long, j long, rank long"
    return in_blocks(part, model, reach, block_width(part, model, reach, BLOCK)).mapInArrow(lambda b: _nearest_batches(b, model, most, reach), schema)


def _nearest_batches(batches: Iterator, model: list[str], most: int, reach: float) -> Iterator:
    """Points look around themselves first; those that met too few others look further."""
    import pyarrow as pa

    for table, group in whole_groups(batches, [*model, "block"]):
        columns = Columns(table)
        xyz, ids, left = np.stack([columns[c] for c in "xyz"], axis=1), columns["atom_id"], np.flatnonzero(columns["own"])
        if not len(left):
            continue
        around = float(np.median(Grid(xyz, group, reach).counts(xyz[left], group[left])))
        radius = min(reach, reach * (27 * 2 * most / around) ** (1 / 3))
        while len(left):
            grid, poor = Grid(xyz, group, radius), []
            for who in np.array_split(left, len(left) // 20_000 + 1):
                found = list(grid.near(xyz[who], group[who], who))
                i, j, d2 = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
                other = ids[who[i]] != ids[j]
                i, j, d2 = i[other], j[other], d2[other]
                rich = np.bincount(i, minlength=len(who)) >= most
                if radius < reach:
                    poor.append(who[~rich])
                    keep = rich[i]
                    i, j, d2 = i[keep], j[keep], d2[keep]
                order = np.lexsort((ids[j], d2, i))
                i, j = i[order], j[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
                i, j, rank = who[i[rank <= most]], j[rank <= most], rank[rank <= most]
                keys = [table.column(c).combine_chunks().take(pa.array(i)) for c in model]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(ids[i]), pa.array(ids[j]), pa.array(rank.astype(np.int64))], [*model, "i", "j", "rank"])
            left, radius = np.concatenate(poor) if poor else left[:0], min(reach, 1.6 * radius)
