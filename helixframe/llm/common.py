"""Helpers of the corpus operators: materialised tables, numbering and components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helixframe import on_workers
from helixframe.tables import drop, drop_tables, materialize, materialize_at, shared_dir

__all__ = ["drop_tables", "materialize", "shared_dir"]

#: ASCII white space of the text contracts.
SPACE = r"[\x20\x09-\x0D]+"


#: Rows and bytes of the batches in which texts go to Python workers: a worker holds a few batches, whatever the texts.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input; sets the session's batches to BATCH_ROWS and BATCH_BYTES where they are larger."""
    on_workers(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        size = int(now) if now.lstrip("-").isdigit() else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now)
        if not 0 < size <= most:
            spark.conf.set(key, str(most))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores added until no taken column has it (case doesn't count)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def row_of(df: DataFrame) -> Column:
    """All columns of df as one struct, so that no column of the user's can clash with one of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def row_order(row: str, kind: StructType) -> Column:
    """A number by which rows that agree in their keys are ordered whatever task met them first; equal rows have equal numbers."""
    mapped = lambda t: "map<" in t.simpleString() or "variant" in t.simpleString()
    return F.xxhash64(*[F.to_json(F.struct(F.col(row)[f.name])) if mapped(f.dataType) else F.col(row)[f.name] for f in kind.fields])


def chunks_for(rows: Column | float) -> Column | int:
    """How many chunks number `rows` rows: both the chunks and the rows of one grow with the square root only."""
    return F.ceil(F.sqrt(rows)).cast("long") if isinstance(rows, Column) else max(1, math.ceil(math.sqrt(rows)))


def number_within(df: DataFrame, group: list[str], chunk: Column, order: list, name: str) -> DataFrame:
    """Adds a gapless number from 0 within each group, without bringing a group into one task.

    A group is cut into chunks; rows are numbered within (group, chunk) and the sizes of the chunks before
    are added. Only the chunk sizes of a group meet, never its rows. df must give the same rows each time it
    is run (read it from a table), and neither group nor chunk may be null: then the join takes the rows as
    the window left them, without another shuffle.
    """
    keyed = df.withColumn("__chunk", chunk)
    sizes = keyed.groupBy(*group, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    local = Window.partitionBy(*group, "__chunk").orderBy(*order)
    numbered = keyed.withColumn("__row", F.row_number().over(local))
    joined = numbered.join(starts, [*group, "__chunk"])
    return joined.select(*df.columns, (F.col("__before") + F.col("__row") - 1).cast("long").alias(name))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b): one row (node, component) per linked node, component its smallest node.

    Alternates large stars and small stars (Kiveris et al. 2014) until the edges no longer change. Each
    half is one aggregation and one equi-join whose large keys Spark may split; a round's edges are written
    to the shared folder, so neither the plan nor the state grows.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")

    def large(e: DataFrame) -> DataFrame:
        sides = both(e)
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return sides.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        lower = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = lower.groupBy("u").agg(F.min("v").alias("m"))
        return lower.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, path = materialize_at(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = mark(now)
    for _ in range(rounds):
        before = path
        now, path = materialize_at(small(large(now).where("a <> b").distinct()).where("a <> b").distinct(), "edges")
        drop(edges.sparkSession, before)
        if (new := mark(now)) == seen:
            stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        seen = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")
