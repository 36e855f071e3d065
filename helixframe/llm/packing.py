"""Packing token sequences by non-negative least squares over shallow length combinations.

Documents become token ids and an end id, cut at multiples of the window. Piece lengths are counted in
bins; combinations of few lengths that fill the window exactly are enumerated; non-negative least squares
finds how often to repeat each so that they use up the histogram; the repeats are rounded down and what is
left is packed greedily, largest first. All of this works on at most WINDOW / GRAIN bin counts, whatever
the number of documents. The result is a table of slots (bin, ranks, first sequence); each piece gets its
rank in its bin and with it sequence and place. Ranks are numbered in chunks, as many as the square root of a bin's
pieces, so a bin that holds a third of all pieces is many tasks at any size.

Token ids are computed once and only lengths and checksums are written, so the later steps move some
dozen bytes a piece. Words repeat, so their ids are kept in bounded dictionaries of each Python worker;
the ids equal those of the whole text because the tokenizer never joins over a space or line break (tested).

Defined cases: a null or empty text is the end id alone; a document longer than the window gives pieces of
the full window and a rest, whatever its length; repeated rows and ids are documents of their own, and which of several
equal pieces comes first makes no difference; a null id stays null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import chunks_for, materialize, number_within, table, text_of

WINDOW, GRAIN, DEPTH, END_ID = 4096, 16, 3, 2
VOCABULARY = "word_bpe_49k.json"
CACHE_PARTS, CACHE_PRETOKENS, CACHE_LENGTH = 100_000, 150_000, 48
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*)([!-&(-/:-@\[-`{-~]*)")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    A text is cut at spaces and line breaks. A part that is letters of ASCII or Latin-1 and then ASCII
    punctuation is two pre-tokens, which go to the tokenizer's model in its own byte letters; any other part goes
    through the whole tokenizer. Parts and pre-tokens are kept in dictionaries of bounded size, which stay
    with the worker from task to task.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        self.model = self.tokenizer.model
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.parts: dict[str, bytes] = {"": b""}
        self.pretokens: dict[str, bytes] = {"": b""}
        spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.letters = {i: spell(chr(i))[0][0] for i in range(0xC0, 0x100) if chr(i).isalpha()}

    def _pretoken(self, word: str) -> bytes:
        ids = self.pretokens.get(word)
        if ids is None:
            raw = self.raw
            ids = b"".join([raw[t.id] for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))])
            if len(self.pretokens) < CACHE_PRETOKENS and len(word) <= CACHE_LENGTH:
                self.pretokens[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        m = _PLAIN.fullmatch(part)
        if m:
            ids = self._pretoken(m[1].lower()) + self._pretoken(m[2])
        else:
            ids = b"".join([self.raw[i] for i in self.tokenizer.encode(part, add_special_tokens=False).ids])
        if len(self.parts) < CACHE_PARTS and len(part) <= CACHE_LENGTH:
            self.parts[part] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        get, part = self.parts.get, self._part
        return b"".join([ids if (ids := get(w)) is not None else part(w) for w in words])


@cache
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def _piece_batches(batches: Iterator, vocabulary: str, window: int) -> Iterator:
    import pyarrow as pa

    encode, end = encoder(vocabulary), END_ID.to_bytes(4, "little")
    for batch in batches:
        ids, starts, lengths, sums, totals = [], [], [], [], []
        for doc, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            data = memoryview(encode(text) + end)
            total = len(data) // 4
            for start in range(0, total, window):
                part = data[4 * start : 4 * (start + window)]
                ids.append(doc.as_py())
                starts.append(start)
                lengths.append(len(part) // 4)
                sums.append(zlib.crc32(part))
                totals.append(total)
        longs = [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *longs], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _piece_batches(b, vocabulary, window), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(present: list[int], units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Multisets of present bins, largest first, that fill the window: up to depth bins, or one bin repeated and one to close."""
    have, found = set(present), set()

    def extend(parts: tuple[int, ...], left: int) -> None:
        if left == 0:
            found.add(parts)
        elif len(parts) == depth - 1:
            if left in have and left <= (parts[-1] if parts else units):
                found.add((*parts, left))
        else:
            for b in present:
                if b <= left and (not parts or b <= parts[-1]):
                    extend((*parts, b), left - b)

    extend((), units)
    for b in present:
        for times in range(2, units // b + 1):
            rest = units - times * b
            if rest == 0 or rest in have:
                found.add(tuple(sorted([b] * times + [rest] * (rest > 0), reverse=True)))
    return sorted(found, reverse=True)


def nnls(a, b, steps: int | None = None):
    """min |a x - b| with x >= 0, by active sets (Lawson and Hanson 1974)."""
    import numpy as np

    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    gradient, slack = a.T @ b, 1e-10 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(steps or 3 * a.shape[0] + 10):
        open_ = np.where(passive, -np.inf, gradient)
        if not n or open_.max() <= slack:
            break
        passive[int(open_.argmax())] = True
        while True:
            index = np.flatnonzero(passive)
            part = a[:, index]
            s = np.linalg.solve(part.T @ part + 1e-12 * np.eye(len(index)), part.T @ b)
            if s.min(initial=1) > 0:
                x[:] = 0
                x[index] = s
                break
            down = s <= 0
            old = x[index][down]
            alpha = float(np.min(old / np.maximum(old - s[down], 1e-300)))
            x[index] += alpha * (s - x[index])
            passive[index[x[index] <= 1e-12]] = False
            x[~passive] = 0
            if not passive.any():
                break
        gradient = a.T @ (b - a @ x)
    return x


def plan(histogram: dict[int, int], units: int) -> list[tuple[tuple[int, ...], int]]:
    """(bins of a sequence, repeats) that use every counted piece exactly once."""
    import numpy as np

    left = {b: n for b, n in histogram.items() if n > 0}
    out: list[tuple[tuple[int, ...], int]] = []

    def use(parts: tuple[int, ...], times: int) -> None:
        if times > 0:
            out.append((parts, times))
            for b in parts:
                left[b] -= times

    def room(parts: tuple[int, ...]) -> int:
        return min(left.get(b, 0) // parts.count(b) for b in set(parts))

    present = sorted(left, reverse=True)
    mixes = combinations(present, units)
    if mixes:
        row = {b: i for i, b in enumerate(present)}
        a = np.zeros((len(present), len(mixes)))
        for j, parts in enumerate(mixes):
            for b in parts:
                a[row[b], j] += 1
        size = np.array(present, dtype=float) / units
        scale = max(left.values())
        x = nnls(a * size[:, None], np.array([left[b] for b in present], dtype=float) * size / scale) * scale
        for j in np.argsort(-x, kind="stable"):
            use(mixes[j], min(int(x[j]), room(mixes[j])))
    while any(left.values()):
        space, parts, free = units, [], dict(left)
        for b in present:
            take = min(space // b, free[b])
            parts += [b] * take
            space -= take * b
        use(tuple(parts), room(tuple(parts)))
    return out


def slots(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(bin, first rank, ranks, times in a sequence, first sequence, first place) for every bin of every entry."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for parts, repeats in found:
        for b in sorted(set(parts), reverse=True):
            times = parts.count(b)
            rows.append((b, used.get(b, 0), times * repeats, times, sequence, parts.index(b)))
            used[b] = used.get(b, 0) + times * repeats
        sequence += repeats
    return rows


SLOTS = T.StructType([T.StructField(n, T.LongType()) for n in ("p_bin", "p_first", "p_ranks", "p_times", "p_sequence", "p_place")])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    binned = pieces(docs, id_col, text_col, vocabulary, window).withColumn("bin", F.ceil(F.col("length") / GRAIN).cast("long"))
    written = materialize(binned, "pieces")
    histogram = {r["bin"]: r["n"] for r in written.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}  # window / GRAIN rows at most
    table_ = spark.createDataFrame(slots(plan(histogram, window // GRAIN)), SLOTS)  # bounded like the histogram
    chunks = [F.lit(x) for b, n in histogram.items() for x in (b, chunks_for(n))]
    of_bin = F.element_at(F.create_map(*chunks), F.col("bin")) if chunks else F.lit(1)
    chunk = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), of_bin.cast("long"))
    ranked = number_within(written, ["bin"], chunk, ["doc_id", "start", "length", "ids_crc32"], "rank")
    inside = (F.col("bin") == F.col("p_bin")) & (F.col("rank") >= F.col("p_first")) & (F.col("rank") < F.col("p_first") + F.col("p_ranks"))
    met = ranked.join(F.broadcast(table_), inside).withColumn("local", F.col("rank") - F.col("p_first"))
    placed = met.withColumn("sequence_id", F.col("p_sequence") + F.floor(F.col("local") / F.col("p_times"))).withColumn("place", F.col("p_place") + F.col("local") % F.col("p_times"))
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long"), F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table in sequences of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))
