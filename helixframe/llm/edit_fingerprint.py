"""Document fingerprints by a randomised embedding of edit distance into Hamming distance.

All texts walk over their code points with shared random functions (Chakraborty, Goldenberg and Koucky
2016): output position j repeats the current code point and moves on if the shared bit h_j(class of the
code point) is set. Two texts that differ by few edits fall back into step after each edit, so their
outputs differ in few positions. How soon they do has a heavy tail, so a text takes WALKS walks with functions of their
own. The fingerprint samples SAMPLES output positions of each walk and keeps DIGIT hashed bits of the code point at each.
The position of a sample is the smallest of a shared random order among the text's own output positions (a record
process), so texts of similar lengths sample the same positions, uniformly over their whole length, and no length bound
is built in. Many texts walk in step as numpy lanes; a text too long for that walks by itself.

Likeness of two fingerprints: the share of equal samples over all walks, freed of chance (1 of 16 samples agrees by
chance), at least 0; equal texts have 1. Two texts are near copies if in some walk the likeness is NEAR or more: walks
that fell out of step don't count against the others.

`near_ids` finds near copies: bands of bits sampled from one walk are the keys of buckets of distinct fingerprints, every
link is verified over all samples, and components of the verified links are the groups. Each bucket first is a
star around one node, the first in an order of all nodes; then buckets of more than two that still hold several components are
asked for all pairs across them, of which each two components keep one link, so the groups are those of all pairs, and a
large group never gives all its pairs. op5 runs it over all fingerprints. Copies are one node before the bands. A band of 44 bits meets by chance for a pair in some
10^10, so candidates stay few at any size. Recall against brute force is measured in the tests and stated in the README.

`edited_neighbours` needs each document's successor in descending id. Ids are cut into ranges of some RANGE_BYTES at
quantiles; rows go to their range, and the first row of a range also to the range before it (the last
range gets the first row of all). Texts move once; the driver holds two ids per range. An id that fills several ranges is cut
further by the hash of its texts, by which rows of one id are ordered.

Defined cases: a null text counts as empty; an empty text samples nothing and has the fixed fingerprint of
the padding; a very long text is walked in blocks; ids are integers or text that casts to one; equal ids are ordered by
the hashes of their texts, then the texts, and a null id comes after all others; repeated rows are successors of each
other; a single row is its own successor; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import components, materialize, table, text_of

SEED, WALKS, SAMPLES, DIGIT = 11, 4, 32, 4
BITS = WALKS * SAMPLES * DIGIT
PERIOD, CLASSES = 8192, 64
LANES, CHUNK_CHARS = 512, 3 << 19  # lanes that walk in step, over texts of CHUNK_CHARS together
ALONE_COST, STEP_COST = 0.2, 5.0  # microseconds of a step alone and of a step of all lanes; they decide how a text walks, never where to
BANDS, BAND_DIGITS, NEAR = 12, 11, 0.75  # bands of each walk
RANGE_BYTES, MOST_RANGES = 16 << 20, 100_000  # beyond MOST_RANGES ranges grow; they are sorted and read as streams
NO_ID = -(1 << 63)


@cache
def _steps():
    """steps[(walk, class, j % PERIOD)], flat: outputs that a code point of the class takes when it is reached at output j; the class after the last takes none."""
    import numpy as np

    moves = np.random.default_rng(SEED).integers(0, 2, size=(WALKS, CLASSES, PERIOD)).astype(bool)
    moves[:, :, -1] = True
    twice = np.concatenate([moves, moves], axis=2)
    at = np.arange(2 * PERIOD)
    nearest = np.minimum.accumulate(np.where(twice, at, 2 * PERIOD)[:, :, ::-1], axis=2)[:, :, ::-1]
    found = np.zeros((WALKS, CLASSES + 1, PERIOD), dtype=np.int64)
    found[:, :CLASSES] = (nearest - at + 1)[:, :, :PERIOD]
    return found.ravel()


@cache
def _step_list() -> list[int]:
    return _steps().tolist()


@cache
def _records():
    """(WALKS * SAMPLES, r) output positions: row k holds the successive minima of the k-th random order of all positions."""
    import numpy as np

    rng = np.random.default_rng(SEED + 1)
    rows = []
    for _ in range(WALKS * SAMPLES):
        at, value, row = 0, rng.random(), []
        while at < 1 << 45:
            row.append(at)
            at += int(rng.geometric(max(value, 1e-15)))
            value *= rng.random()
        rows.append(row)
    wide = max(map(len, rows))
    return np.array([r + [1 << 60] * (wide - len(r)) for r in rows], dtype=np.int64)


def _codes(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _rows_of(codes):
    """Where the steps of each code point's class start."""
    import numpy as np

    return (codes.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(9)) % np.uint64(CLASSES) * np.uint64(PERIOD)


def _walk_alone(codes, start: int, walk: int):
    """The output position at which each code point is reached, and the position after the last, as an array."""
    import numpy as np

    steps, mask, at, parts, base = _step_list(), PERIOD - 1, int(start), [], walk * (CLASSES + 1) * PERIOD
    for block in range(0, len(codes), 1 << 16):
        reached = []
        add = reached.append
        for row in (_rows_of(codes[block : block + (1 << 16)]) + np.uint64(base)).tolist():
            add(at)
            at += steps[row + (at & mask)]
        parts.append(np.array(reached, dtype=np.int64))
    return np.concatenate([*parts, np.array([at], dtype=np.int64)])


def _lanes(sizes: list[int], lanes: int) -> list[list[int]]:
    """The texts of each lane: longest first, each to the lane that ends first."""
    ends, found = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        end, lane = heapq.heappop(ends)
        found[lane].append(k)
        heapq.heappush(ends, (end + sizes[k] + 1, lane))
    return found


def _walk_in_step(texts: list, starts: list, lanes: int) -> list:
    """The same for all walks of many texts, which follow each other in lanes; per text an array (WALKS, length + 1)."""
    import numpy as np

    steps, mask = _steps(), PERIOD - 1
    dealt = _lanes([len(t) for t in texts], lanes)
    longest = max(sum(len(texts[k]) + 1 for k in lane) for lane in dealt)
    rows = np.full((longest, lanes), CLASSES * PERIOD, dtype=np.int64)  # after a text a step of nothing
    fresh: dict[int, list] = defaultdict(list)
    place = {}
    for lane, members in enumerate(dealt):
        at = 0
        for k in members:
            rows[at : at + len(texts[k]), lane] = _rows_of(texts[k])
            fresh[at].append((lane, starts[k]))
            place[k] = at, lane
            at += len(texts[k]) + 1
    base = (np.arange(WALKS) * (CLASSES + 1) * PERIOD)[:, None]
    found = np.zeros((longest + 1, WALKS, lanes), dtype=np.int64)
    index, taken = np.empty_like(found[0]), np.empty_like(found[0])
    band, take, add = np.bitwise_and, np.take, np.add
    for i in range(longest):
        now = found[i]
        if i in fresh:
            for lane, first in fresh[i]:
                now[:, lane] = first
        band(now, mask, out=index)
        index += rows[i]
        index += base
        take(steps, index, out=taken, mode="clip")
        add(now, taken, out=found[i + 1])
    return [np.ascontiguousarray(found[at : at + len(t) + 1, :, lane].T) for t, (at, lane) in ((t, place[k]) for k, t in enumerate(texts))]


def walks(texts: list, starts: list) -> list:
    """Per text an array (WALKS, length + 1) of output positions; starts gives the first ones."""
    import numpy as np

    found: list = [None] * len(texts)
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    sizes = np.array([len(texts[k]) + 1 for k in order])
    rest = np.append(sizes[::-1].cumsum()[::-1], 0)  # from each text on
    steps = np.maximum(np.append(sizes, 0), rest * WALKS // LANES)
    alone = int(np.argmin((rest[0] - rest) * WALKS * ALONE_COST + steps * STEP_COST))  # the longest texts, as far as that is cheaper
    for k in order[:alone]:
        found[k] = np.stack([_walk_alone(texts[k], starts[k][w], w) for w in range(WALKS)])
    if order[alone:]:
        lanes = min(LANES // WALKS, int(rest[alone] // sizes[alone]))
        for k, walked in zip(order[alone:], _walk_in_step([texts[k] for k in order[alone:]], [starts[k] for k in order[alone:]], lanes), strict=True):
            found[k] = walked
    return found


def _samples(texts: list, reached: list):
    """(texts, WALKS * SAMPLES): the fingerprints' samples from the walks, DIGIT bits each."""
    import numpy as np

    n, records = WALKS * SAMPLES, _records()
    symbols = np.zeros((len(texts), n), dtype=np.uint64)
    lengths = np.array([r[:, -1] for r in reached], dtype=np.int64).reshape(len(texts), WALKS)
    where = np.stack([records[k][np.maximum(np.searchsorted(records[k], lengths[:, k // SAMPLES], side="left") - 1, 0)] for k in range(n)], axis=1)
    for d, (codes, walked) in enumerate(zip(texts, reached, strict=True)):
        if len(codes):
            for w in range(WALKS):
                part = slice(w * SAMPLES, (w + 1) * SAMPLES)
                symbols[d, part] = codes[walked[w].searchsorted(where[d, part], side="right") - 1]
            symbols[d] += np.uint64(1)
    mixed = (symbols * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(40)) % np.uint64(1 << DIGIT)).astype(np.uint8)


def _hex(samples) -> str:
    """One hex digit a sample."""
    return (samples[::2] << 4 | samples[1::2]).tobytes().hex()


def fingerprint(text: str | None) -> str:
    """BITS / 4 hex digits."""
    codes = _codes(text or "")
    return _hex(_samples([codes], walks([codes], [[0] * WALKS]))[0])


def _freed(share: float) -> float:
    chance = 1 / (1 << DIGIT)
    return max(0.0, (share - chance) / (1 - chance))


def _likeness(a, b) -> float:
    return _freed(float((a == b).mean()))


def _parsed(fp: str):
    import numpy as np

    return np.array([int(c, 16) for c in fp], dtype=np.uint8)


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints in hex digits."""
    return _likeness(_parsed(a), _parsed(b))


def best_likeness(a: str, b: str) -> float:
    """The largest likeness of two fingerprints in one walk, by which near copies are told."""
    return max(_freed(float(x)) for x in (_parsed(a) == _parsed(b)).reshape(WALKS, SAMPLES).mean(axis=1))


def _rows(batches: Iterator) -> Iterator:
    """Lists of (bucket, tail, id, text), some CHUNK_CHARS of text each."""
    rows, size = [], 0
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for row in zip(*columns, strict=True):
            rows.append(row)
            size += len(row[3])
            if size >= CHUNK_CHARS:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _neighbour_batches(batches: Iterator) -> Iterator:
    """Fingerprints of rows sorted by bucket and descending id; a bucket's tail rows only serve as its last row's successor."""
    import numpy as np
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    last: list = []
    for rows in _rows(batches):
        codes = [_codes(r[3]) for r in rows]
        reached = walks(codes, [[0] * WALKS] * len(rows))
        met = last + list(zip(rows, codes, reached, _samples(codes, reached), strict=True))
        pairs = [(a, b) for a, b in zip(met, met[1:], strict=False) if a[0][0] == b[0][0] and not a[0][1]]
        last = met[-1:]
        tails, starts, keeps = [], [], []
        for (_, own, walked, _), (_, then, _, _) in pairs:
            n = len(own)
            keeps.append(n - n // 2)
            tails.append(then[: n // 2])
            starts.append(walked[:, keeps[-1]].tolist())
        further = walks(tails, starts)
        joined = [np.concatenate([p[0][1][:keep], tail]) for p, keep, tail in zip(pairs, keeps, tails, strict=True)]
        edits = _samples(joined, [np.concatenate([p[0][2][:, :keep], more], axis=1) for p, keep, more in zip(pairs, keeps, further, strict=True)])
        out: list[tuple] = []
        for ((row, own, _, samples), then), keep, changed in zip(pairs, keeps, edits, strict=True):
            edited = row[3][:keep] + then[0][3][: len(own) // 2]
            out.append((None if row[2] == NO_ID else row[2], len(own), hashlib.sha256(edited.encode()).hexdigest(), _hex(samples), _hex(changed), _likeness(samples, changed), _likeness(samples, then[3])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    import numpy as np

    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text_of(text_col).alias("text")).select("id", F.xxhash64("text").alias("h"), "text")
    if ranges is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = min(MOST_RANGES, max(16 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    cuts = rows.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges + 1000).alias("cuts")).first()["cuts"]
    bounds, times = np.unique(np.array(cuts if ranges > 1 and cuts else [], dtype=np.int64), return_counts=True)
    ends = np.append(0, np.cumsum(times))  # ranges below each bound; a bound that stands several times has several of its own
    n = int(ends[-1]) + 1

    @F.pandas_udf("long")
    def bucket(ids: pd.Series, hashes: pd.Series) -> pd.Series:  # larger ids first, of one id smaller hashes
        ids, at = ids.to_numpy(), np.searchsorted(bounds, ids.to_numpy(), side="left")
        own = np.append(bounds, 0)[at] == ids
        most = np.where(own & (at < len(bounds)), np.append(times, 1)[at], 1)
        place = (hashes.to_numpy() >> 32) + (1 << 31)
        return pd.Series(n - 1 - ends[at] - (most - 1 - (place * most >> 32)))

    dealt = rows.withColumn("bucket", bucket("id", "h"))
    heads = dealt.groupBy("bucket").agg(F.max(F.struct("id", F.bitwise_not("h").alias("least_h"))).alias("head")).orderBy("bucket").collect()  # one narrow row a range; ~h falls as h grows
    before = [(r["head"]["id"], ~r["head"]["least_h"], heads[k - 1]["bucket"]) for k, r in enumerate(heads)]  # the range before; before the first comes the last
    known = spark.createDataFrame(before, "id long, h long, bucket long")  # MOST_RANGES narrow rows at most
    tails = rows.join(F.broadcast(known), ["id", "h"]).dropDuplicates(["bucket"]).select("bucket", F.lit(True).alias("tail"), "id", "h", "text")
    placed = dealt.select("bucket", F.lit(False).alias("tail"), "id", "h", "text").unionByName(tails)
    ordered = placed.repartition("bucket").sortWithinPartitions("bucket", "tail", F.desc("id"), "h", "text").select("bucket", "tail", "id", "text")
    return ordered.mapInArrow(_neighbour_batches, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def bands(bits: str = "bits"):
    """Array of keys: the hash of BAND_DIGITS samples of one walk, masked in the fingerprint's longs, and of the band's number."""
    import numpy as np

    rng = np.random.default_rng(SEED + 2)
    longs, keys = SAMPLES * DIGIT // 64, []
    for band in range(WALKS * BANDS):
        masks = [0] * longs
        for digit in rng.choice(SAMPLES, BAND_DIGITS, replace=False).tolist():
            masks[digit // 16] |= 15 << 60 - 4 * (digit % 16)
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        keys.append(F.xxhash64(F.lit(band), *[F.col(bits)[band // BANDS * longs + k].bitwiseAND(F.lit(m).cast("long")) for k, m in enumerate(signed)]))
    return F.array(*keys)


def _words(fp: str):
    """The fingerprint as signed longs of 16 digits."""
    return F.array(*[F.conv(F.substring(fp, 1 + 16 * i, 16), 16, -10).cast("long") for i in range(BITS // 64)])


def _near(a: str, b: str, least: float):
    """Whether some walk's samples agree as much as `least` asks."""
    most = SAMPLES - math.ceil(SAMPLES * (least + (1 - least) / (1 << DIGIT)) - 1e-9)
    longs = SAMPLES * DIGIT // 64

    def differ(i: int):
        x = F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])
        half = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(half.bitwiseOR(F.shiftrightunsigned(half, 2)).bitwiseAND(F.lit(0x1111111111111111)))

    out = F.lit(False)
    for w in range(WALKS):
        out = out | (sum((differ(w * longs + i) for i in range(longs)), F.lit(0)) <= most)
    return out


def near_ids(fingerprints: DataFrame, id_col: str = "id", least: float = NEAR) -> DataFrame:
    """(fingerprint, near_id) of each distinct fingerprint: near_id is the smallest id of the group of verified links at likeness `least` or more in some walk."""
    grouped = fingerprints.groupBy("fingerprint").agg(F.min(id_col).alias("rep"))
    nodes = materialize(grouped.select("fingerprint", "rep", F.monotonically_increasing_id().alias("node"), _words("fingerprint").alias("bits")), "edit-nodes")  # the written numbers are the nodes
    placed = nodes.select("node", F.explode(bands()).alias("key"))
    stars = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64("node")).alias("centre")).where("n > 1")  # one order for all buckets, so that a group has few centres
    buckets = materialize(placed.join(stars, "key"), "edit-buckets")
    bits = nodes.select("node", "bits")

    spokes = buckets.where("node <> centre").select("node", "centre").distinct().join(bits, "node").alias("m")
    links_1 = materialize(spokes.join(bits.alias("c"), (F.col("m.centre") == F.col("c.node")) & _near("m", "c", least)).select(F.col("m.node").alias("a"), F.col("m.centre").alias("b")), "edit-links")
    known = materialize(components(links_1), "edit-components")
    wider = buckets.where("n > 2")  # the one pair of a smaller bucket is a spoke
    named = materialize(wider.join(known, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "edit-buckets")
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.mode("component").alias("main")).where("low < high").select("key", "main")
    open_ = materialize(named.join(mixed, "key").join(bits, "node"), "edit-buckets")
    across = (F.col("p.key") == F.col("q.key")) & (F.col("p.component") != F.col("q.component")) & _near("p", "q", least)
    met = open_.where("component <> main").alias("p").join(open_.alias("q"), across)
    links_2 = materialize(met.select(F.least("p.component", "q.component").alias("a"), F.greatest("p.component", "q.component").alias("b")).distinct(), "edit-links")  # one link joins two components
    over = components(links_2).select(F.col("node").alias("part"), F.col("component").alias("group"))
    placed_in = nodes.join(known, "node", "left").select("fingerprint", "rep", F.coalesce("component", "node").alias("part"))
    member = materialize(placed_in.join(over, "part", "left").select("fingerprint", "rep", F.coalesce("group", "part").alias("group")), "edit-members")
    smallest = member.groupBy("group").agg(F.min("rep").alias("near_id"))
    return materialize(member.join(smallest, "group").select("fingerprint", "near_id"), "edit-groups")


def near_groups(fingerprints: DataFrame, id_col: str = "id", least: float = NEAR) -> DataFrame:
    """(id, fingerprint, near_id) of every row."""
    return fingerprints.select(F.col(id_col).alias("id"), "fingerprint").join(near_ids(fingerprints, id_col, least), "fingerprint").select("id", "fingerprint", "near_id")


def op5_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the whole `documents` table and of its edited texts, and the group of near copies."""
    found = materialize(edited_neighbours(table(spark, sf_dir, "documents")), "edited")
    return found.join(near_ids(found), "fingerprint").select(F.col("id").alias("doc_id"), *found.columns[1:], "near_id")
