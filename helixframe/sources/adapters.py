"""Structure-shaped views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe import on_workers
from helixframe.operators.shape import plddt_category


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as atoms: 100 times the first three components, label as chain, eight atoms a residue."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: (F.col("embedding")[i].cast("double") * 100).alias("xyz"[i])
    return e.select(
        F.col("vec_id").alias("atom_id"), at(0), at(1), at(2), F.col("label").cast("string").alias("chain"),
        F.floor(F.col("vec_id") / 8).cast("long").alias("resid"), F.format_string("R%02d", F.col("vec_id") % 20).alias("resname"),
    )


#: The same view in SQL, for oracles.
POINTS_SQL = """pts AS (SELECT vec_id AS atom_id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 100 AS z,
  label::VARCHAR AS chain, (vec_id // 8)::BIGINT AS resid, printf('R%02d', vec_id % 20) AS resname FROM embeddings)"""

#: Secondary structure state that an event type stands for.
STATES = {"click": "AlphaHelix", "view": "Strand", "purchase": "Coil", "signup": "Turn", "error": "Bend"}


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as residues of one model per user: confidence from the value, state from the type, in order of time."""
    e = table(spark, sf_dir, "events")
    score = F.col("value") % 100
    state = F.try_element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), F.col("event_type"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("model_id"), F.row_number().over(order).cast("long").alias("position"), score.alias("score"), plddt_category(score).alias("plddt"), state.alias("dssp"))


RESIDUES_SQL = f"""res AS (SELECT user_id AS model_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position, value % 100 AS score,
  CASE WHEN value % 100 > 90 THEN 'VeryHigh' WHEN value % 100 > 70 THEN 'High' WHEN value % 100 > 50 THEN 'Low' ELSE 'VeryLow' END AS plddt,
  CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items())} END AS dssp FROM events)"""


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as particles of one model per order, weighted by price."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("model_id"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"), F.col("l_extendedprice").alias("weight"))


PARTICLES_SQL = "par AS (SELECT l_orderkey AS model_id, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z, l_extendedprice AS weight FROM lineitem)"


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user with the arrays of its residues; sequences repeat the letters of the standard residues."""
    letters = F.substring(F.lit("ARNDCQEGHILKMFPSTWYV"), (F.col("position") % 20 + 1).cast("int"), F.lit(1))
    each = F.array_sort(F.collect_list(F.struct("position", letters.alias("aa"), "score", "plddt", "dssp"))).alias("r")
    rows = residues(spark, sf_dir).groupBy("model_id").agg(each)
    return rows.select(F.col("model_id").cast("string").alias("model_id"), F.array_join(F.col("r.aa"), "").alias("sequence"), F.lit(None).cast("string").alias("taxonomy_id"), F.lit(None).cast("string").alias("organism"), F.col("r.plddt").alias("plddt"), F.col("r.score").alias("plddt_score"), F.col("r.dssp").alias("dssp"))
