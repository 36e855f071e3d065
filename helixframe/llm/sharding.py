"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard bids for a key with weight / -ln(u), u uniform from an MD5 of (key, shard); the highest bid
wins, so a shard wins its share of the weights and a further shard takes rows only into itself. Nothing is
looked up or moved: the bids are expressions on one row. The slot of a row in its shard is numbered in
chunks, as many as the square root of a shard's rows, so no shard's rows meet in one task at any size.

Defined cases: a null key is hashed as the text 'null'; a null text has no bytes and an empty one none either, a very
long one counts whole; of equal bids the shard with the larger number wins; repeated rows and keys go to the same shard
and get slots of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import chunks_for, materialize, number_within, table, text_of

SHARDS = 16
_BITS = 52


def _name(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def bid(key: Column, shard: int, weight: float) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", _name(key), F.lit(str(shard)))), 1, _BITS // 4), 16, 10).cast("double")
    return F.lit(float(weight)) / -F.ln((bits + 0.5) / F.lit(float(1 << _BITS)))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key among len(weights) weighted shards; of equal bids the larger number wins."""
    bids = [F.struct(bid(key, i, w).alias("bid"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return F.array_max(F.array(*bids))["shard"]


def shard(docs: DataFrame, weights: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard): grown_shard is the shard if one of weight 1 is added."""
    weights = weights or [1.0] * SHARDS
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    bids = rows.select("*", *[bid(F.col("id"), i, w).alias(f"bid_{i}") for i, w in enumerate([*weights, 1.0]) if w > 0])
    best = lambda n: F.array_max(F.array(*[F.struct(F.col(f"bid_{i}").alias("bid"), F.lit(i).alias("shard")) for i, w in enumerate([*weights, 1.0][:n]) if w > 0]))["shard"]
    placed = materialize(bids.select("id", "size", "text_crc32", best(len(weights)).alias("shard"), best(len(weights) + 1).alias("grown_shard")), "shards")
    chunks = chunks_for(placed.count() / max(1, sum(w > 0 for w in weights)))
    chunk = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", _name(F.col("id")), F.lit("slot"), F.col("text_crc32").cast("string"))), 1, 12), 16, 10).cast("long"), F.lit(chunks))
    return number_within(placed, ["shard"], chunk, ["id", "text_crc32", "size"], "slot")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table on 16 shards of equal weight."""
    found = shard(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _crc_steps() -> list[int]:
    """What four bits at the low end of a CRC-32 register turn into."""
    steps = list(range(16))
    for _ in range(4):
        steps = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in steps]
    return steps


# DuckDB has no CRC-32, so its register is run over the hexadecimal digits, four bits a step.
ORACLE = f"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, (octet_length(encode(text)) + 1)::BIGINT AS size,
        xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h)), lambda i: (instr('0123456789ABCDEF', h[(i - i % 2 + 2 - i % 2)::BIGINT]) - 1)::BIGINT)),
            lambda c, x: xor(c >> 4, ({_crc_steps()}::BIGINT[])[(xor(c & 15, x) + 1)::BIGINT])), 4294967295) AS text_crc32 FROM h),
s AS (SELECT doc_id, unnest(range({SHARDS + 1})) AS shard FROM documents),
b AS (SELECT doc_id, shard, 1.0::DOUBLE / -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || shard), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << _BITS)!r}::DOUBLE) AS bid FROM s),
w AS (SELECT doc_id, arg_max(shard, bid) FILTER (shard < {SHARDS}) AS shard, arg_max(shard, bid) AS grown_shard FROM b GROUP BY doc_id),
n AS (SELECT greatest(1, ceil(sqrt(count(*) / {float(SHARDS)!r}::DOUBLE)))::BIGINT AS chunks FROM documents),
p AS (SELECT d.*, w.shard, w.grown_shard, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|slot|' || text_crc32), 1, 12))::BIGINT % (SELECT chunks FROM n) AS chunk FROM d JOIN w USING (doc_id))
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY chunk, doc_id, text_crc32, size) - 1 AS slot, grown_shard::INT AS grown_shard FROM p
"""
