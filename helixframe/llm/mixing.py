"""Mixing sources to target weights by Poisson replication.

A source with weight w and size s gets the repetition rate w * total / s. Each document inverts a Poisson
distribution with that mean at a uniform number seeded by its id, is repeated that often, and the copies
are dealt to partitions and sorted by a hash of (id, copy): a global shuffle without a sampling pass.
Expected source sizes match the weights exactly; the same seed gives the same rows on any cluster.

Sizes are code points of the whole texts over all rows. Default weights are proportional to the square
root of the sizes (temperature 2). The rate table has a row per source with its distribution function; it is broadcast
only if it was measured to hold at most BROADCAST_BYTES, beyond that it is an ordinary equi-join.

Defined cases: a null or empty text has size 0, a very long one counts whole, and a null source is a source of its own; a
source of size 0 keeps rate 1; a null id is hashed as the text 'null'; repeated rows and ids get the same count each;
copies of rows with one id and copy number tie in the shuffle key and stand together in any order; an empty table gives no
rows; other columns pass through whatever their names: where docs has a column named rate, copies, copy or shuffle_key,
the added one gets a final underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import free_name, materialize, row_of, table

SEED = 17
BROADCAST_BYTES = 8 << 20
ADDED = ("rate", "copies", "copy", "shuffle_key")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, rate): the mean number of copies of a document of the source."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.char_length(text_col), F.lit(0)).cast("long")).alias("size"))
    if weights is None:
        weight = F.sqrt(F.col("size").cast("double"))
    else:
        pairs = [F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0))
    shares = sizes.select("source", "size", weight.alias("w"))
    total = shares.agg(F.sum("size").alias("all_size"), F.sum("w").alias("all_w"))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("all_w") == 0, F.lit(0.0)).otherwise(F.col("w") * F.col("all_size") / (F.col("all_w") * F.col("size")))
    return shares.crossJoin(total).select("source", rate.alias("rate"))  # total is one row


def thresholds(rate: DataFrame) -> DataFrame:
    """(source, rate, cdf): the distribution function of each source's Poisson law at 0, 1, ..."""
    k = F.explode(F.sequence(F.lit(0), (F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int"))).alias("k")
    up = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = rate.select("source", "rate", k)
    logs = steps.withColumn("logp", -F.col("rate") + F.when(F.col("k") == 0, F.lit(0.0)).otherwise(F.col("k") * F.ln("rate")) - F.sum(F.when(F.col("k") == 0, F.lit(0.0)).otherwise(F.ln("k"))).over(up))
    whole = logs.withColumn("c", F.sum(F.when((F.col("rate") == 0) & (F.col("k") > 0), F.lit(0.0)).otherwise(F.exp("logp"))).over(up))
    return whole.groupBy("source", "rate").agg(F.array_sort(F.collect_list("c")).alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", ordered: bool = True) -> DataFrame:
    """docs with each row repeated by its Poisson count, in global random order; adds rate, copies, copy, shuffle_key."""
    law = materialize(thresholds(rates(docs, weights, source_col, text_col)), "rates").select(F.col("source").alias("of_source"), "rate", "cdf")
    size = law.agg(F.sum(64 + 8 * F.size("cdf") + F.coalesce(F.octet_length(F.col("of_source").cast("string")), F.lit(0)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        law = F.broadcast(law)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    drawn = docs.select(row_of(docs).alias("row"), name.alias("name"), F.col(source_col).alias("source")).withColumn("u", uniform(F.col("name"), F.lit(seed)))
    met = drawn.join(law, F.col("source").eqNullSafe(F.col("of_source")))
    counted = met.withColumn("copies", F.size(F.filter("cdf", lambda c: c <= F.col("u"))))
    copied = counted.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    keyed = copied.select("row", *ADDED[:-1], F.md5(F.concat_ws("|", "name", F.col("copy"), F.lit(seed))).alias("shuffle_key"))
    dealt = keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key") if ordered else keyed
    return dealt.select("row.*", *[F.col(c).alias(free_name(c, docs.columns)) for c in ADDED])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table mixed with temperature 2."""
    return mix(table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 6))


ORACLE = f"""
WITH s AS (SELECT source, sum(coalesce(length(text), 0)) AS size FROM documents GROUP BY source),
w AS (SELECT source, size, sqrt(size::DOUBLE) AS w FROM s),
r AS (SELECT source, CASE WHEN size = 0 THEN 1.0::DOUBLE WHEN (SELECT sum(w) FROM w) = 0 THEN 0.0::DOUBLE
        ELSE w * (SELECT sum(size) FROM w)::DOUBLE / ((SELECT sum(w) FROM w) * size) END AS rate FROM w),
k AS (SELECT source, rate, unnest(range(0, (floor(rate + 12 * sqrt(rate) + 30))::BIGINT + 1)) AS k FROM r),
l AS (SELECT source, rate, k, -rate + CASE WHEN k = 0 THEN 0 ELSE k * ln(rate) END
        - sum(CASE WHEN k = 0 THEN 0 ELSE ln(k::DOUBLE) END) OVER (PARTITION BY source ORDER BY k) AS logp FROM k),
c AS (SELECT source, rate, k, sum(exp(logp)) OVER (PARTITION BY source ORDER BY k) AS c FROM l),
u AS (SELECT *, row_number() OVER () AS row_no, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|{SEED}'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents),
n AS (SELECT u.row_no, u.doc_id, u.text, u.lang, u.source, u.n_chars, c.rate, count(*) FILTER (c.c <= u.u) AS copies
      FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY u.row_no, u.doc_id, u.text, u.lang, u.source, u.n_chars, c.rate),
x AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM n)
SELECT doc_id, text, lang, source, n_chars, round(rate, 6) AS rate, copies::INT AS copies, copy::INT AS copy,
       md5(coalesce(doc_id::VARCHAR, 'null') || '|' || copy || '|{SEED}') AS shuffle_key FROM x
"""
