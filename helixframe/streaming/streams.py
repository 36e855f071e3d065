"""Structured Streaming forms of the batch operators.

Files arrive through Spark's file source, so progress and recovery are the checkpoint's; rates are limited by
files per trigger. Topology is small and static against frames: a stream-static join needs no state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources.structures import ATOMS, _atom_batches

FRAMES = "model_id string, frame int, time_ps double, source_file string, positions array<struct<x: double, y: double, z: double>>"


def structure_stream(spark: SparkSession, path: str, pattern: str = "*", files_per_trigger: int = 16) -> DataFrame:
    """Atoms of structure files as they appear in a folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return files.select("path", "content").mapInArrow(lambda b: _atom_batches(b, False), ATOMS)


def frame_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Frames from a folder of Parquet files."""
    return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def frame_atoms(frames: DataFrame, topology: DataFrame) -> DataFrame:
    """Atoms of each frame: positions exploded and joined with the static atoms of the model. Works on streams and tables."""
    placed = frames.select("model_id", "frame", "time_ps", F.posexplode("positions").alias("atom_id", "p"))
    static = topology.drop("frame", "x", "y", "z")
    return placed.join(static, ["model_id", "atom_id"]).select("model_id", "frame", "time_ps", "atom_id", *[c for c in static.columns if c not in ("model_id", "atom_id")], "p.x", "p.y", "p.z")


def windowed_counts(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; rows later than `delay` are dropped by the watermark."""
    late = events.withWatermark("ts", delay)
    return late.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def session_counts(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    late = events.withWatermark("ts", delay)
    return late.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))


def running_contacts(contacts: DataFrame) -> DataFrame:
    """Running number of contacts and nearest distance per model, as keyed state of one row a model."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        n, nearest = state.get if state.exists else (0, float("inf"))
        for pdf in batches:
            n += len(pdf)
            nearest = min(nearest, float(pdf["distance_sq"].min()))
        state.update((n, nearest))
        yield pd.DataFrame({"model_id": [key[0]], "n_contacts": [n], "nearest_sq": [nearest]})

    kept = contacts.select("model_id", "distance_sq")
    return kept.groupBy("model_id").applyInPandasWithState(update, "model_id string, n_contacts long, nearest_sq double", "n long, nearest double", "update", GroupStateTimeout.NoTimeout)


def deliver(df: DataFrame, sinks: list[tuple[Callable[[DataFrame, int], object], bool]], checkpoint: str, timeout: float | None = 60.0, failures: list | None = None) -> bool:
    """Gives each micro-batch to all sinks, (function of batch and its number, required); whether all that had arrived was done in time.

    What an optional sink raises is put into `failures`; a required one ends the query, and the batch comes again from the
    checkpoint, so sinks should write by batch number. After `timeout` seconds the query is stopped between batches.
    """
    def give(batch: DataFrame, number: int) -> None:
        kept = batch.persist() if len(sinks) > 1 else batch
        try:
            for sink, required in sinks:
                try:
                    sink(kept, number)
                except Exception as e:
                    if required:
                        raise
                    if failures is not None:
                        failures.append((number, f"{type(e).__name__}: {e}"))
        finally:
            if len(sinks) > 1:
                kept.unpersist()

    query = df.writeStream.foreachBatch(give).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    done = query.awaitTermination(timeout) if timeout is not None else (query.awaitTermination() or True)
    if not done:
        query.stop()
    return bool(done)


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what has arrived into an in-memory table and stops."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
