"""Algebra of contact sets: tables with unique keys (model, frame, lhs, rhs, type) and a squared distance.

Keys decide equality, distances never do; where both sides hold a key, the left row stays. All operations
are equi-joins on the key, so sets that are bucketed or partitioned by model need no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.interactions import code_column

KEY = ("model_id", "frame", "lhs", "rhs", "type")


def key_of(df: DataFrame) -> list[str]:
    return [k for k in KEY if k in df.columns]


def ordered(df: DataFrame) -> DataFrame:
    """lhs and rhs swapped where needed so that lhs <= rhs."""
    return df.withColumns({"lhs": F.least("lhs", "rhs"), "rhs": F.greatest("lhs", "rhs")})


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(difference(right, left))


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select(*key_of(left)), key_of(left), "left_semi").select(*left.columns)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select(*key_of(left)), key_of(left), "left_anti").select(*left.columns)


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return difference(left, right).unionByName(difference(right, left))


def insert(left: DataFrame, more: DataFrame) -> DataFrame:
    """Appends rows as they are; duplicates stay until `distinct_contacts`."""
    return left.unionByName(ordered(more))


def distinct_contacts(df: DataFrame) -> DataFrame:
    """One row per key, the one with the smallest distance."""
    best = Window.partitionBy(*key_of(df)).orderBy("distance_sq")
    return df.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def make_generic(df: DataFrame) -> DataFrame:
    """All types become Generic; of several contacts of a pair the one with the smallest distance stays."""
    return distinct_contacts(df.withColumn("type", F.lit("Generic")))


def sort_contacts(df: DataFrame) -> DataFrame:
    """Order of lhs, rhs, then the type's packed number."""
    return df.orderBy("lhs", "rhs", code_column(F.col("type")))


def count_by_type(df: DataFrame) -> DataFrame:
    return df.groupBy("type").agg(F.count(F.lit(1)).alias("n_contacts"))


def altloc_compatible(a: Column, b: Column) -> Column:
    """Whether two alternate locations may meet: equal, or one of them empty."""
    return (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "") | (a == b)


def resolve(contacts: DataFrame, atoms: DataFrame, key: str = "atom_id", columns: tuple = ("name", "resname", "resid", "chain")) -> DataFrame:
    """Adds both sides' atom columns as <name>_l and <name>_r by equi-joins."""
    shared = [c for c in ("model_id", "frame") if c in contacts.columns and c in atoms.columns]
    out = contacts
    for side, column in (("l", "lhs"), ("r", "rhs")):
        part = atoms.select(*shared, F.col(key).alias(column), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        out = out.join(part, [*shared, column], "left")
    return out
