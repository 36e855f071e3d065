"""Outputs: NDJSON in one file or in shards, positions, summaries, and the pipeline's named channels."""

from __future__ import annotations

import inspect
import json
import os
import struct
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def payload(df: DataFrame, column: str = "payload") -> DataFrame:
    """Rows as JSON text; a payload column is taken as it is."""
    return df.select(column) if column in df.columns else df.select(F.to_json(F.struct(*df.columns)).alias(column))


def ndjson(df: DataFrame, path: str) -> None:
    """One file of one payload a line, the earlier one replaced."""
    payload(df).coalesce(1).write.mode("overwrite").text(path)


def sharded_ndjson(df: DataFrame, path: str, max_records: int = 0, max_bytes: int = 0) -> None:
    """Files of at most max_records rows, and of about max_bytes each if given."""
    out = payload(df)
    if max_bytes:
        total = out.agg(F.sum(F.octet_length("payload") + 1)).first()[0] or 0
        out = out.repartition(max(1, -(-int(total) // max_bytes)))
    writer = out.write.mode("overwrite")
    (writer.option("maxRecordsPerFile", max_records) if max_records else writer).text(path)


def memory(df: DataFrame, limit: int = 1_000_000) -> list[str]:
    """Payloads on the driver; more than `limit` rows raise instead of filling it."""
    rows = payload(df).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write them to files")
    return [r[0] for r in rows]


def stdout(df: DataFrame) -> None:
    for row in payload(df).toLocalIterator():
        sys.stdout.write(row[0] + "\n")


def fnv1a(data: bytes, bits: int = 64) -> int:
    """FNV-1a of 32 or 64 bits."""
    value, prime = (0xCBF29CE484222325, 0x100000001B3) if bits == 64 else (0x811C9DC5, 0x01000193)
    mask = (1 << bits) - 1
    for byte in data:
        value = (value ^ byte) * prime & mask
    return value


def positions_path(name: str, depth: int) -> str:
    """Folders of 0, 1 or 2 levels by the bytes of the name's hash, and the file."""
    h = fnv1a(name.encode())
    parts = [f"{h >> 8 * i & 255:02x}" for i in range(depth)]
    return "/".join([*parts, name + ".bin"])


def positions(models: DataFrame, depth: int = 1) -> DataFrame:
    """(path, content): coordinates as little-endian float32 triples; rows to be written by any file sink."""
    if depth not in (0, 1, 2):
        raise ValueError("depth is 0, 1 or 2")

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            for name, coords in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flat = [v for p in coords for v in (p["x"], p["y"], p["z"])]
                yield pa.RecordBatch.from_pydict({"path": [positions_path(name, depth)], "content": [struct.pack(f"<{len(flat)}f", *flat)]})

    return models.where(F.size("coords") > 0).select("model_id", "coords").mapInArrow(pack, "path string, content binary")


def contact_text(contacts: DataFrame) -> DataFrame:
    """(payload): one line a contact with both labels, type and distance; contacts have label_l and label_r."""
    return contacts.select(F.format_string("%s %s %s %.4f", "label_l", "label_r", "type", F.sqrt("distance_sq")).alias("payload"))


def contact_rows(contacts: DataFrame) -> DataFrame:
    """(payload): a JSON object a contact, in full."""
    return contacts.select(F.to_json(F.struct(*contacts.columns)).alias("payload"))


def decode_contacts(spark, paths: str | list[str]) -> DataFrame:
    """Contacts that were written in columns (Parquet) or as JSON rows, read back in parallel as columns."""
    first = paths if isinstance(paths, str) else paths[0]
    if first.rstrip("/").endswith((".json", ".ndjson", ".jsonl")):
        return spark.read.schema("model_id string, frame int, lhs long, rhs long, type string, distance_sq double").json(paths)
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths))


@dataclass
class Options:
    """What a pipeline's structural tasks take from its user: whether topology is derived, by which typing, and whether items are predicted models."""

    typing: str = "molstar"
    topology: bool = True
    models: bool = False

    def __post_init__(self):
        from helixframe.operators.contacts import PROVIDERS

        if self.typing not in PROVIDERS:
            raise ValueError(f"typing is one of {', '.join(PROVIDERS)}")

    def contacts(self, source: DataFrame, only=None) -> DataFrame:
        """Contacts of a channel of atoms, or of models, with these options."""
        from helixframe.operators.contacts import contacts
        from helixframe.sources.model_atoms import model_atoms, model_bonds

        if not self.topology:
            raise ValueError("contacts need the topology")
        return contacts(model_atoms(source), self.typing, only, bond=model_bonds(source)) if self.models else contacts(source, self.typing, only)


def write_files(files: DataFrame, folder: str) -> int:
    """Writes (path, content) rows as files below a folder that all executors mount, and returns how many; a file is replaced as a whole."""
    from helixframe import on_workers

    spark = files.sparkSession
    on_workers(spark)
    local = folder.removeprefix("file://")
    if "://" in local:
        raise ValueError("single files go to a mounted folder; write the rows with a DataFrame writer elsewhere")

    def put(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = os.path.join(local, path.lstrip("/"))
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(f"{target}.part", "wb") as f:  # a task that runs again replaces what an earlier one left
                    f.write(content)
                os.replace(f"{target}.part", target)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return files.select("path", "content").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


def summary(df: DataFrame, path: str) -> dict:
    """The one row of a summary table as a JSON file; returns it."""
    row = df.first().asDict(recursive=True)
    df.sparkSession.createDataFrame([(json.dumps(row),)], "payload string").coalesce(1).write.mode("overwrite").text(path)
    return row


class Pipeline:
    """Named channels over one source: tasks are DataFrame functions, run once each, with any number of sinks.

    Tasks see their dependencies' results by name. A failing row-wise function gives a row with an error
    instead of a failed run.
    """

    def __init__(self, source: DataFrame):
        self.channels: dict[str, DataFrame] = {"source": source}
        self.sinks: list[tuple[str, Callable[[DataFrame], object], bool]] = []
        self.report: list[dict] = []
        self.tasks: list[tuple[str, tuple[str, ...]]] = []

    def add_task(self, name: str, task: Callable[..., DataFrame], depends: tuple[str, ...] | None = None, requires: tuple[str, ...] = ()) -> Pipeline:
        """Adds a channel. Without `depends` the task's parameters name its channels; `requires` are columns that the first of them must have."""
        depends = depends if depends is not None else self._inferred(task)
        missing = [d for d in depends if d not in self.channels]
        if missing or name in self.channels:
            raise ValueError(f"unknown dependency {missing}" if missing else f"channel {name!r} exists")
        lacking = [c for c in requires if c not in self.channels[depends[0]].columns] if requires else []
        if lacking:
            raise ValueError(f"channel {depends[0]!r} has no column {', '.join(lacking)}")
        self.channels[name] = task(*[self.channels[d] for d in depends])
        self.tasks.append((name, depends))
        return self

    def _inferred(self, task: Callable) -> tuple[str, ...]:
        """The channels that a task's parameters name; a single parameter of another name stands for the source."""
        names = [p.name for p in inspect.signature(task).parameters.values() if p.default is p.empty]
        return tuple(names) if all(n in self.channels for n in names) and names else ("source",)

    def add_item_task(self, name: str, function: Callable[[dict], object], depends: str = "source", key: str = "model_id", requires: tuple[str, ...] = ()) -> Pipeline:
        """A Python function per row; its result is the payload (text as it is, else JSON). With `requires` only these columns and the key reach it."""
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                keys, out = [], []
                for row in batch.to_pylist():
                    keys.append(str(row[key]))
                    try:
                        value = function(row)
                        out.append(value if isinstance(value, str) or value is None else json.dumps(value))
                    except Exception as e:  # noqa: BLE001  a failing item must not end the run
                        out.append(json.dumps({"error": {"source": name, "message": str(e)}, "path": str(row[key])}))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(out, pa.string())], [key, "payload"])

        kept = lambda df: df.select(*dict.fromkeys((key, *requires))) if requires else df
        return self.add_task(name, lambda df: kept(df).mapInArrow(run, f"{key} string, payload string"), (depends,), requires)

    def attach(self, name: str, sink: Callable[[DataFrame], object], required: bool = True) -> Pipeline:
        """A sink of a channel; what an optional one raises is reported and doesn't end the run."""
        if name not in self.channels:
            raise ValueError(f"no channel {name!r}")
        self.sinks.append((name, sink, required))
        return self

    def describe(self) -> str:
        return "\n".join(f"{name} <- {', '.join(depends)}" for name, depends in self.tasks)

    def run(self) -> dict[str, list]:
        """Runs all sinks; a channel with several is kept between them. Returns the sinks' results by channel; `report` holds the run's metrics."""
        results: dict[str, list] = {}
        self.report = []
        names = [n for n, _, _ in self.sinks]
        many = {n for n in names if names.count(n) > 1}
        for name in many:
            self.channels[name] = self.channels[name].persist()
        try:
            for name, sink, required in self.sinks:
                metrics, observed = self._observed(name)
                start, error = time.perf_counter(), None
                try:
                    results.setdefault(name, []).append(sink(observed))
                except Exception as e:
                    if required:
                        raise
                    error = f"{type(e).__name__}: {e}"
                    results[name].append(None)
                self.report.append({"channel": name, "seconds": time.perf_counter() - start, "error": error} | ({} if error else _counts(metrics)))
        finally:
            for name in many:
                self.channels[name].unpersist()
        return results

    def _observed(self, name: str) -> tuple[Observation, DataFrame]:
        """A channel that counts its rows, and those with an error, while a sink reads it."""
        df, metrics = self.channels[name], Observation()
        bad = F.col("error").isNotNull() if "error" in df.columns else F.col("payload").startswith('{"error"') if "payload" in df.columns else F.lit(False)
        return metrics, df.observe(metrics, F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(bad, F.lit(False))).alias("failed"))


def _counts(metrics: Observation) -> dict:
    """What an observation saw; nothing if the sink never read the channel, which would block for ever."""
    jvm = metrics._jo
    return dict(metrics.get) if jvm is not None and jvm.getOrEmpty().nonEmpty() else {}
