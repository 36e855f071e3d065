"""Personal data: pattern spans and information-theoretic sanitisation of the terms that give them away.

Base spans (e-mail addresses, IP addresses, card and phone numbers) come from patterns. The terms around
them are judged by corpus co-occurrence (Sanchez and Batet 2016): with document frequencies over the whole
corpus, a term t reveals an entity value c by PMI(c; t) / IC(c), which is 1 if t stands nowhere but near c.
All four counts are rows of the corpus, repeated ones included. Every pair is judged, also one that occurs once. A pair counts unless chance explains it: with t and c in
of_term and of_entity of N documents, chance puts them together of_term * of_entity / N = m times, and k
times or more with probability at most m^k / k!, which must not exceed CHANCE. k is the number of different
word windows around c that hold t, so copies of one passage are one piece of evidence. Terms at or above GENERALISE are spans of kind `term` wherever they stand;
`sanitise` replaces them by their shape, and removes them at or above REMOVE.

Steps, each over all rows: (1) patterns, and the pairs of entity, term and window, one narrow row per document; (2) all pairs of entity and
term, by aggregation; (3) document frequencies of just these terms, counted
in the scan and pre-aggregated per task; (4) spans of the revealing terms. Between the steps only a bit
set is sent with the tasks, of some 32 bits per term within SET_BITS and MAX_SET_BITS, three of them set; it may let extra
terms through, which an equi-join removes, so results are exact. Where a step's set is empty, the step would add nothing and isn't run.

Defined cases: a null text counts as empty; a very long text is read whole and its term spans are written in blocks;
patterns are leftmost and non-overlapping per kind, failing matches are dropped without retry; a term that ties at a
threshold is above it; repeated rows, also those with a null id, get equal results; an empty table gives no rows; other
columns, whatever their names, are not read and pass through `sanitise`.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import materialize, row_of, table, text_of

KINDS = ("email", "ip", "card", "phone")
WINDOW, CHANCE, GENERALISE, REMOVE, SET_BITS, MAX_SET_BITS, PROBES = 8, 0.05, 0.9, 0.98, 1 << 20, 1 << 25, (0, 21, 39)

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # the contract's matches: digits are taken greedily, so none starts or ends within a run of them
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]+")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; each starts where the run of local characters before an @ starts."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            out.append(m.span())
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then start."""
    out = [("email", *s) for s in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, 7) - (1 << 63)


def _words_before(text: str, start: int) -> list[str]:
    """The last WINDOW words before start; reads twice as far back until they are all found whole."""
    reach = 40 * WINDOW
    while True:
        low = max(0, start - reach)
        found = list(_TERM.finditer(text, low, start))
        if low and found and found[0].start() == low:  # may be cut
            del found[0]
        if not low or len(found) >= WINDOW:
            return [m.group().lower() for m in found[-WINDOW:]]
        reach *= 2


def _windows(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[int], list[dict]]:
    """The distinct entities of a text, and its evidence: entity, term and the window (hash of its words) that holds both.

    Each pair of entity and term also stands once without a window: that counts the row.
    """
    entities, pairs = set(), set()
    for kind, start, end in spans:
        left = _words_before(text, start)
        right = [m.group().lower() for m in islice(_TERM.finditer(text, end), WINDOW)]
        entity, window = _hash(f"{kind}:{text[start:end]}"), _hash(" ".join([*left, "|", *right]))
        entities.add(entity)
        for term in {_hash(w) for w in (*left, *right)}:
            pairs |= {(entity, term, window), (entity, term, None)}
    return list(entities), [{"entity": e, "term": t, "window": w} for e, t, w in pairs]


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _base_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kind = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("window", pa.int64())]))
    for batch in batches:
        counts: list[list[int]] = [[] for _ in KINDS]
        sums, spans, entities, pairs = [], [], [], []
        for text in batch.column(2).to_pylist():
            found = base_spans(text)
            for n, k in zip(counts, KINDS, strict=True):
                n.append(sum(s[0] == k for s in found))
            spans.append(_join(found))
            sums.append(hashlib.sha256(spans[-1].encode()).hexdigest())
            for column, values in zip((entities, pairs), _windows(text, found), strict=True):
                column.append(values)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(n, pa.int64()) for n in counts), pa.array(sums), pa.array(spans), pa.array(entities, pa.list_(pa.int64())), pa.array(pairs, kind)], ["id", "row_hash", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "entities", "pairs"])


def _has(bits: bytes, h: int) -> int:
    size = 8 * len(bits)
    for shift in PROBES:
        at = (h >> shift) % size
        if not bits[at >> 3] >> (at & 7) & 1:
            return 0
    return 1


def bit_set(terms: DataFrame) -> bytes:
    """The terms' hashes as a set of bits; the driver gets at most one row per set byte, each of a few bytes, as Arrow columns."""
    import numpy as np

    size = min(MAX_SET_BITS, max(SET_BITS, 1 << (32 * terms.agg(F.approx_count_distinct("term")).first()[0]).bit_length()))
    at = F.pmod("probe", F.lit(size))
    rows = terms.select(F.explode(F.array(*[F.shiftright("term", x) for x in PROBES])).alias("probe")).select(F.floor(at / 8).cast("int").alias("byte"), F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8 + 1).cast("int")).alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 8, dtype=np.uint8)
    out[rows["byte"].to_numpy()] = rows["bits"].to_numpy()
    return out.tobytes()


def _frequency_batches(batches: Iterator, bits: bytes) -> Iterator:
    """(term, documents) of this task for the terms in the set."""
    import pyarrow as pa

    def batch(found: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["term", "documents"])

    found: Counter = Counter()
    for part in batches:
        for text in part.column(0).to_pylist():
            found.update(h for h in map(_hash, set(_TERM.findall(text.lower()))) if _has(bits, h))
            if len(found) > 1 << 18:
                yield batch(found)
                found = Counter()
    if found:
        yield batch(found)


def _term_batches(batches: Iterator, bits: bytes) -> Iterator:
    """(id, row_hash, term, start, end) of the terms in the set."""
    import pyarrow as pa

    for batch in batches:
        for i, text in enumerate(batch.column(2).to_pylist()):
            rows = [(h, m.start(), m.end()) for m in _TERM.finditer(text) if _has(bits, h := _hash(m.group().lower()))]
            for at in range(0, len(rows), 10_000):
                part = rows[at : at + 10_000]
                ids = [pa.array([batch.column(c)[i].as_py()] * len(part), batch.column(c).type) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(list(x), pa.int64()) for x in zip(*part, strict=True))], ["id", "row_hash", "term", "start", "end"])


def disclosures(found: DataFrame, rows: DataFrame, chance: float = CHANCE, least: float = GENERALISE) -> DataFrame | None:
    """(term, disclosure) of the terms that reveal an entity; None if there is no pair."""
    evidence = found.select(F.explode("pairs").alias("p")).select("p.*").groupBy("entity", "term", "window").agg(F.count(F.lit(1)).alias("rows"))
    counted = evidence.groupBy("entity", "term").agg(F.count("window").alias("contexts"), F.sum(F.when(F.col("window").isNull(), F.col("rows"))).alias("together"))
    pairs = materialize(counted, "pairs")
    if pairs.isEmpty():
        return None
    bits = bit_set(pairs.select("term"))
    of_term = rows.select("text").mapInArrow(lambda b: _frequency_batches(b, bits), "term long, documents long").groupBy("term").agg(F.sum("documents").alias("of_term"))
    of_entity = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("of_entity"))
    total = found.count()
    pmi = F.log2(F.col("together") * F.lit(float(total)) / (F.col("of_term") * F.col("of_entity")))
    ic = F.log2(F.lit(float(total)) / F.col("of_entity"))
    judged = pairs.join(of_entity, "entity").join(of_term, "term").where("of_entity < %d" % total).withColumn("disclosure", pmi / ic)
    k = F.col("contexts")
    by_chance = k * F.log(F.col("of_term") * F.col("of_entity") / F.lit(float(total))) - F.when(k <= 20, F.log(F.factorial(F.least(k, F.lit(20)).cast("int")).cast("double"))).otherwise(k * F.log(k) - k)  # k! >= (k / e)^k
    return materialize(judged.where((F.col("disclosure") >= least) & (by_chance <= F.log(F.lit(chance)))).groupBy("term").agg(F.max("disclosure").alias("disclosure")), "terms")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row_hash, n_email .. n_phone, base_sha256, spans, removed): removed lists the `term` spans to take out altogether."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).select("id", F.xxhash64("text").alias("row_hash"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    found = materialize(rows.mapInArrow(_base_batches, f"id {kind}, row_hash long, {counts}, base_sha256 string, spans string, entities array<long>, pairs array<struct<entity: long, term: long, window: long>>"), "pii")
    base = found.drop("entities", "pairs")
    terms = disclosures(found, rows)
    if terms is None or terms.isEmpty():
        return base.withColumn("removed", F.lit(""))
    bits = bit_set(terms)
    places = rows.mapInArrow(lambda b: _term_batches(b, bits), f"id {kind}, row_hash long, term long, start long, end long").distinct().join(terms, "term")
    span = F.struct("start", "end", (F.col("disclosure") >= REMOVE).alias("remove"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat(F.lit("term:"), s["start"], F.lit(":"), s["end"])), ",")
    per_row = places.groupBy("id", "row_hash").agg(F.array_sort(F.collect_list(span)).alias("s"))
    more = per_row.select(F.col("id").alias("__id"), F.col("row_hash").alias("__hash"), text(F.col("s")).alias("__terms"), text(F.filter("s", lambda x: x["remove"])).alias("removed"))
    met = base.join(more, F.col("id").eqNullSafe(F.col("__id")) & (F.col("row_hash") == F.col("__hash")), "left")
    spans = F.concat_ws(",", F.nullif("spans", F.lit("")), "__terms")
    return met.select("id", "row_hash", *(f"n_{k}" for k in KINDS), "base_sha256", spans.alias("spans"), F.coalesce("removed", F.lit("")).alias("removed"))


def sanitise_text(text: str, spans: str, removed: str = "") -> str:
    """The text with base spans replaced by [KIND], term spans by the shape of the word, and removed terms taken out."""
    gone, out, at = set(removed.split(",")), [], 0
    parsed = sorted((int(s), -int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x))
    for start, end, kind in parsed:
        end = -end
        if start < at:
            if end > at:
                at = end
            continue
        out.append(text[at:start])
        if kind != "term":
            out.append(f"[{kind.upper()}]")
        elif f"term:{start}:{end}" not in gone:
            out.append("[WORD]" if text[start:end].isalpha() else "[TOKEN]")
        at = end
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with sanitised texts; all other columns stay."""
    @F.pandas_udf("string")
    def clean(text: pd.Series, spans: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([sanitise_text(t, s, r) for t, s, r in zip(text, spans, removed, strict=True)])

    found = find(docs, id_col, text_col).select("id", "row_hash", "spans", "removed").dropDuplicates(["id", "row_hash"])
    rows = docs.select(row_of(docs).alias("row"), F.col(id_col).alias("row_id"), text_of(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    met = rows.join(found, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("row_hash")))
    cleaned = met.select("row", clean("text", "spans", "removed").alias("clean"))
    return cleaned.select(*[F.col("clean").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in the whole `documents` table."""
    found = find(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), *(f"n_{k}" for k in KINDS), "base_sha256", "spans")
