"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits: bit b is set if it is set in more than half of the XXH64 values of the text's
word shingles, repeats included. Fingerprints within three bits of each other are linked. Cut into two
segments of 32 bits, at least one segment of a linked pair differs in at most one bit, so the table holds
each segment of each distinct fingerprint, and each fingerprint asks for the Hamming ball of radius one
around its segments; every match is verified over all 64 bits. A pair one bit apart is asked for only from
the side that has the bit, which halves the probes and loses no pair. The probe join returns verified
links only.

Equal fingerprints are one node from the start (partial aggregation collapses copies before the shuffle),
so groups of copies cost nothing here. Components come from alternating stars.

`near_dedup` has its own measure: texts are near copies if the sets of their five-word shingles have a
Jaccard similarity of SIMILAR or more. At 0.8 a bit of a SimHash differs with probability 0.15, some ten of 64 bits, and
balls that reach so far hold more than 10^5 keys. So the fingerprint of a set is longer, and the index has more segments,
asked for without a ball: as many segments as find a pair at SIMILAR with probability RECALL, each three bits
longer than the number of rows, so that unrelated texts seldom meet (`segmented`). Equal segments make
candidates, and every candidate is verified on the whole shingle sets. Pairs none of whose segments agree, and those of
very small sets, whose bits differ more often, are also asked for by BANDS bands of ROWS minima of the shingle hashes (at 0.8 with
probability 0.9993, above it more). Texts of one set are one node. First the bucket of each segment or band is a star around one
node, the first in an order of all nodes; then buckets of more than two that still hold several components
give all pairs across them, so the components are those of all candidate pairs, while a large group never
gives all its pairs. Sizes too far apart, and signatures of MINIMA minima that agree in DEVIATIONS standard deviations
fewer than a pair at SIMILAR does, are dropped before the sets are read (such a pair with probability 0.0002).

Defined cases: null text counts as empty; a text without words has fingerprint zero and links like any
other; with fewer words than the shingle size the whole word sequence is the one shingle; a very long text is read whole,
its shingles in blocks; a null id is never the smallest unless a group has no other; repeated rows and ids give one
output row each in `near_groups` and `similar_groups`, while `near_dedup` keeps one row of a group, also of rows that repeat
one another; an empty table gives no rows; other columns, whatever their names, are not read and pass through `near_dedup`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import components, materialize, row_of, row_order, table, text_of

SEED = 42
BITS, SEGMENT_BITS, MAX_DISTANCE = 64, 32, 3
SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 24, 6
RECALL, SHORTEST, LONGEST = 0.9, 16, 31  # of the segments alone at SIMILAR; bits of a segment
MINIMA, DIGIT, DEVIATIONS = 384, 4, 3.5  # minima of a signature, bits kept of each, how far below its expectation a pair may agree
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def simhash(text: str | None, size: int = 3) -> int:
    """The fingerprint of one text as an unsigned integer."""
    import numpy as np
    import xxhash

    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts, ends, at = [], [], 0
    for word in words:
        starts.append(at)
        at += len(word)
        ends.append(at)
        at += 1
    digest = xxhash.xxh64_digest
    total, counts, shingles = len(words) - size + 1, np.zeros(BITS, dtype=np.int64), zip(starts, ends[size - 1 :], strict=False)
    while block := b"".join([digest(joined[i:j], SEED) for i, j in _take(shingles, 65536)]):
        bits = np.unpackbits(np.frombuffer(block, dtype=np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def _take(items: Iterator, n: int) -> list:
    from itertools import islice

    return list(islice(items, n))


def _fingerprint_batches(batches: Iterator, size: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        found = np.array([simhash(x, size) for x in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found)], ["id", "row_hash", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, row_hash, fp): fp holds the 64 bits as a signed long, row_hash is XXH64 of the text."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).select("id", "text", F.xxhash64("text").alias("row_hash"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _fingerprint_batches(b, size), f"id {kind}, row_hash long, fp long")


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp within MAX_DISTANCE bits."""
    mask = (1 << SEGMENT_BITS) - 1

    def segments(df: DataFrame) -> DataFrame:
        high = F.shiftrightunsigned("fp", SEGMENT_BITS)
        low = F.col("fp").bitwiseAND(F.lit(mask).cast("long"))
        return df.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), high.alias("key")), F.struct(F.lit(1).alias("seg"), low.alias("key")))).alias("s")).select("fp", "s.seg", "s.key")

    stored = segments(nodes)
    bit = F.array(*[F.lit(1 << i).cast("long") for i in range(SEGMENT_BITS)])
    ball = F.concat(F.array(F.lit(0).cast("long")), F.filter(bit, lambda b: F.col("key").bitwiseAND(b) != 0))
    asked = segments(nodes).select("fp", "seg", "key", F.explode(ball).alias("flip")).select(F.col("fp").alias("a"), "seg", F.col("key").bitwiseXOR(F.col("flip")).alias("key"), "flip")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE
    once = (F.col("flip") != 0) | (F.col("a") < F.col("b"))
    found = asked.alias("p").join(stored.select(F.col("fp").alias("b"), "seg", "key").alias("t"), (F.col("p.seg") == F.col("t.seg")) & (F.col("p.key") == F.col("t.key")) & near & once)
    return found.select("a", "b")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """One row per row of docs: id, row_hash, fp, component_id (the smallest id that links reach)."""
    rows = materialize(fingerprints(docs, id_col, text_col, size), "simhash")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "nodes")
    member = components(links(nodes.select("fp")))
    named = member.join(nodes, member["node"] == nodes["fp"]).groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = member.join(named, "component").select(F.col("node").alias("fp"), "component_id")
    whole = materialize(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "groups")  # so that Spark may split a hot fingerprint below
    return rows.join(whole, "fp").select("id", "row_hash", "fp", "component_id")


def shingle_set(text: str | None, size: int = SHINGLE):
    """The distinct XXH64 values of a text's word shingles, sorted; all words are the one shingle of a shorter text."""
    import numpy as np
    import xxhash

    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    found = (b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in found), dtype=np.uint64))


def segmented(rows: int, least: float = SIMILAR, recall: float = RECALL) -> tuple[int, int]:
    """(width, count) of the segments that find a pair of sets at Jaccard `least` among so many rows with probability `recall`."""
    width = min(LONGEST, max(SHORTEST, rows.bit_length() + 3))
    met = (1 - math.acos(2 * least / (1 + least)) / math.pi) ** width  # that one segment of a pair agrees
    return width, 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - met))


def segments(shingles, width: int, count: int):
    """The SimHash of a shingle set in `count` segments of `width` bits: a bit is set if more than half of the shingles' hashes have it."""
    import numpy as np

    words = -(-width * count // 64)
    rng = np.random.default_rng(SEED + 1)
    shift, factor = (rng.integers(0, 1 << 64, words, dtype=np.uint64) for _ in range(2))
    factor |= np.uint64(1)
    counts = np.zeros((8, words * 8), dtype=np.int64)
    for at in range(0, len(shingles), 255):  # bytes count up to 255
        mixed = (shingles[at : at + 255, None] ^ shift) * factor
        mixed ^= mixed >> np.uint64(32)
        mixed *= factor
        mixed ^= mixed >> np.uint64(29)
        for bit in range(8):
            counts[bit] += ((mixed >> np.uint64(bit)) & np.uint64(0x0101010101010101)).sum(axis=0, dtype=np.uint64).view(np.uint8)
    bits = (counts * 2 > len(shingles)).ravel(order="F")[: width * count].reshape(count, width)
    return bits @ (1 << np.arange(width))


def _minima(shingles):
    """The minima of a shingle set under MINIMA shared random orders; the first BANDS * ROWS make the bands."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    factor, shift = (rng.integers(0, 1 << 64, MINIMA, dtype=np.uint64) for _ in range(2))
    least = np.full(MINIMA, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[at : at + 1024, None] * (factor | np.uint64(1)) + shift).min(axis=0))
    return least


def _signature_batches(batches: Iterator, size: int, width: int, count: int, bands: int) -> Iterator:
    """Per text a 128-bit hash of its shingle set, the set's size, DIGIT bits of each minimum and the key of each segment and band."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    for batch in batches:
        nodes, sizes, bits, keys = [], [], [], []
        for text in batch.column(1).to_pylist():
            found = shingle_set(text, size)
            least = _minima(found)
            nodes.append(xxhash.xxh3_128_digest(found.tobytes(), SEED))
            sizes.append(len(found))
            mixed = (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - DIGIT)).astype(np.uint8)
            bits.append((mixed[::2] << DIGIT | mixed[1::2]).view(np.int64).tolist())
            banded = np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least[: bands * ROWS].reshape(bands, ROWS))], dtype=np.uint64)
            keys.append(np.concatenate([segments(found, width, count) | np.arange(count) << LONGEST, banded.view(np.int64)]))
        columns = [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["id", "row_hash", "shingle_set", "size", "bits", "keys"])


def _set_batches(batches: Iterator, size: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [shingle_set(x, size).view(np.int64) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, size: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets are at least so similar."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "row_hash"), "node")
    texts = docs.select(text_of(text_col).alias("text")).select("text", F.xxhash64("text").alias("row_hash")).join(asked, "row_hash")
    sets = materialize(texts.dropDuplicates(["node"]).select("node", "text").mapInArrow(lambda b: _set_batches(b, size), "node long, shingles array<long>"), "shingles")
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return materialize(met.where(both + 1e-9 >= least * (F.size("x") + F.size("y") - both)).select("a", "b"), "links")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = SIMILAR, bands: int = BANDS) -> DataFrame:
    """One row per row of docs: id, row_hash, component_id (the smallest id that verified links reach), group (a number of the group).

    Without bands (0) the SimHash segments alone make candidates.
    """
    width, count = segmented(docs.count(), least)
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).select("id", "text", F.xxhash64("text").alias("row_hash"))
    kind = source.schema["id"].dataType.simpleString()
    signed = materialize(source.mapInArrow(lambda b: _signature_batches(b, size, width, count, bands), f"id {kind}, row_hash long, shingle_set binary, size long, bits array<long>, keys array<long>"), "signatures")
    first = lambda c: F.min_by(c, "row_hash").alias(c)
    grouped = signed.groupBy("shingle_set").agg(F.min("id").alias("rep"), F.min("row_hash").alias("row_hash"), first("size"), first("bits"), first("keys"))
    nodes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")  # the written numbers are the nodes

    placed = nodes.select("node", F.explode("keys").alias("key"))
    stars = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64("node")).alias("centre")).where("n > 1")
    buckets = materialize(placed.join(stars, "key"), "buckets")

    differ = (1 - least) * (1 - 2.0**-DIGIT)
    most = int(MINIMA * differ + DEVIATIONS * (MINIMA * differ * (1 - differ)) ** 0.5)

    def digits_apart(x, y):
        v = x.bitwiseXOR(y)
        half = v.bitwiseOR(F.shiftrightunsigned(v, 1))
        return F.bit_count(half.bitwiseOR(F.shiftrightunsigned(half, 2)).bitwiseAND(F.lit(0x1111111111111111)))

    def fits(a: str, b: str):
        apart = F.aggregate(F.zip_with(f"{a}.bits", f"{b}.bits", digits_apart), F.lit(0), lambda s, n: s + n)
        return (F.least(f"{a}.size", f"{b}.size") + 1e-9 >= least * F.greatest(f"{a}.size", f"{b}.size")) & (apart <= most)

    def pair(a: str, b: str):
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    narrow = nodes.select("node", "size", "bits")
    asked = buckets.where("node <> centre").select("node", "centre").distinct().join(narrow, "node").alias("m")
    spokes = materialize(asked.join(narrow.alias("c"), (F.col("m.centre") == F.col("c.node")) & fits("m", "c")).select(*pair("m.node", "c.node")).distinct(), "pairs")
    links_1 = _verified(spokes, nodes, docs, text_col, size, least)
    known = components(links_1)

    wider = buckets.where("n > 2")  # the one pair of a smaller bucket is a spoke
    named = materialize(wider.join(known, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "buckets")
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.mode("component").alias("main")).where("low < high").select("key", "main")
    open_ = materialize(named.join(mixed, "key").join(nodes.select("node", "size", "bits", "keys"), "node"), "buckets")
    once = ((F.col("q.component") == F.col("q.main")) | (F.col("p.node") < F.col("q.node"))) & (F.array_min(F.array_intersect("p.keys", "q.keys")) == F.col("p.key"))  # a pair meets in the first bucket that it shares
    across = (F.col("p.key") == F.col("q.key")) & (F.col("p.component") != F.col("q.component")) & fits("p", "q") & once
    rest = open_.where("component <> main").alias("p").join(open_.alias("q"), across).select(*pair("p.node", "q.node")).distinct().join(spokes, ["a", "b"], "left_anti")
    links_2 = _verified(materialize(rest, "pairs"), nodes, docs, text_col, size, least)

    member = components(links_1.unionByName(links_2))
    least_id = member.join(nodes, "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = member.join(least_id, "component").select("node", "component", "component_id")
    met = nodes.select("shingle_set", "node", "rep").join(linked, "node", "left")
    whole = materialize(met.select("shingle_set", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("component", "node").alias("group")), "groups")
    return signed.select("id", "row_hash", "shingle_set").join(whole, "shingle_set").select("id", "row_hash", "component_id", "group")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = SIMILAR) -> DataFrame:
    """docs with one document of each group of similar_groups, a row with the smallest id; all columns stay.

    Several rows of a group may share that id: of them the row with the smallest text hash stays, then the one with the
    smallest hash over all columns. Only rows that repeat id and text are shuffled for that.
    """
    own = similar_groups(docs, id_col, text_col, size, least).where(F.col("id").eqNullSafe(F.col("component_id")))
    each = own.groupBy("group", "id", "row_hash").agg(F.count(F.lit(1)).alias("rows"))
    keep = materialize(each.groupBy("group").agg(F.min_by(F.struct("id", F.col("row_hash").alias("least_hash"), "rows"), "row_hash").alias("k")).select("k.*"), "keep")
    rows = docs.select(row_of(docs).alias("row"), F.col(id_col).alias("row_id"), F.xxhash64(text_of(text_col)).alias("row_hash"))
    met = lambda k: rows.join(k, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("least_hash")))
    several = met(keep.where("rows > 1")).groupBy("row_id", "row_hash").agg(F.min_by("row", row_order("row", docs.schema)).alias("row"))
    return met(keep.where("rows = 1")).select("row.*").unionByName(several.select("row.*"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of the whole `documents` table."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
