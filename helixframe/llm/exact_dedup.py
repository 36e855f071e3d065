"""Exact deduplication by a 128-bit content hash with a byte comparison inside groups.

Texts are equal when they are identical after every run of ASCII white space became one space. The rows
are grouped by MD5 and the normalised bytes themselves: the hash spreads the work, the bytes decide, so
two texts with one hash stay two groups. Partial aggregation leaves one row per text and task before the
shuffle, however many copies there are. A row finds its group by (MD5, SHA-256) in an equi-join without an
aggregate above it, so Spark may split the partition of a hot text.

Defined cases: a null text counts as empty; an empty text is a text like any other, and a very long one is hashed and
compared whole; rows with a null id count in their group, are its keeper only if no row has an id, and compare
null-safe; ties of the smallest id, that is rows that repeat both id and text, share their decision in `exact_groups`, and
`exact_dedup` keeps one of them, the one with the smallest hash over all columns; an empty table gives no rows; other
columns, whatever their names, are never read by `exact_groups` and pass unchanged through `exact_dedup`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import SPACE, row_of, row_order, table, text_of


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_of(text), SPACE, " ")


def content_hash(norm: Column) -> Column:
    """MD5: 128 bits, kept as 16 bytes."""
    return F.unhex(F.md5(norm))


def _groups(docs: DataFrame, id_col: str, text_col: str, hasher) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    same = rows.select("id", "norm", hasher(F.col("norm")).alias("h")).groupBy("h", "norm")
    found = same.agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return found.select("h", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher=content_hash) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256."""
    norm = normalised(text_col)
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).select("id", hasher(F.col("norm")).alias("h"), F.sha2("norm", 256).alias("sha"))
    found = rows.join(_groups(docs, id_col, text_col, hasher), ["h", "sha"])
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher=content_hash) -> DataFrame:
    """docs without the rows that copy another one; all columns stay.

    The join carries the id as a third key, so the copies of a hot text spread over all tasks. Of rows that agree in id
    and text, the one with the smallest hash over all columns stays, so a task that runs again keeps the same row.
    """
    norm = normalised(text_col)
    key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null")).alias("key")  # noqa: E731  never null, so an ordinary equi-join
    rows = docs.select(row_of(docs).alias("row"), key(F.col(id_col)), hasher(norm).alias("h"), F.sha2(norm, 256).alias("sha"))
    keep = _groups(docs, id_col, text_col, hasher).select("h", "sha", key(F.col("keep_id")))
    met = rows.join(keep, ["h", "sha", "key"])
    return met.groupBy("h", "sha", "key").agg(F.min_by("row", row_order("row", docs.schema)).alias("row")).select("row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of the whole `documents` table."""
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
