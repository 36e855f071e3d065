"""Tables written to the folder that driver and executors share, to cut lineage and plans."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a folder of this machine serves in local mode, in which driver and executors are one process; on
    a cluster that would lose rows, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="helixframe-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        found = f"file://{found}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/helixframe-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a fresh table in the shared folder and reads it again.

    This cuts the lineage: a lost executor costs at most the tasks after it, and what follows reads the
    written rows however often it is run again. `drop_tables` removes what a session has written.
    """
    return materialize_at(df, name)[0]


def materialize_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table and its path. The shuffle files of the write go when it is done: nothing reads them again."""
    spark = df.sparkSession
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_tables(spark: SparkSession) -> None:
    """Removes the tables that this session's operators have written; call it when their results are no longer read."""
    drop(spark, _tables(spark))
