"""A training corpus from `documents`: quality, exact copies, near copies, mixture, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Stages are written as Parquet to the shared
folder and read again, so a lost executor never costs more than the stage it was in. All but the last return
the columns of documents, further ones included, whatever their names.

Defined cases: a null text counts as empty and is scored, grouped and packed like an empty one; without labels of both
kinds every document has one score and all stay or go by the share of good labels (0.5, so all stay, without any);
rows that repeat one another become one in the exact stage; ties of the smallest id are broken by hashes over all
columns; null ids and sources are values of their own; a very long text is read whole by every stage; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import common, exact_dedup, mixing, packing, quality, simhash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled documents of this stage's input."""
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the sources meet their target weights, in global random order."""
    return mixing.mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor XXH64 nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
