"""The pipeline's stages on a small corpus, against brute force where it can be told."""

import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("helixframe.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def _corpus(spark, path):
    good = lambda i: " ".join(f"word{(i * 31 + k * k) % 997}" for k in range(120)) + "."
    texts = [good(i) for i in range(240)] + [good(i) for i in range(40)] + ["BUY!! NOW!! $$$ ### " * 40 + str(i) for i in range(120)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"copy": F.lit("kept"), "kept": F.lit(1)}).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 280), 0) for i in range(len(texts)) if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return texts


def test_stages(spark, tmp_path):
    texts = _corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = docs.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "kept"] and {r["copy"] for r in seen[name]} == {"kept"}
    assert {r.doc_id for r in seen["quality"]} == set(range(280))
    assert {r.doc_id for r in seen["exact dedup"]} == set(range(240))
    assert {r.doc_id for r in seen["near dedup"]} == set(range(240))
    assert {r.doc_id for r in seen["packing"]} == {r.doc_id for r in seen["mixing"]}
    assert all(re.sub(r"\s+", " ", r.text) == texts[r.doc_id] for r in seen["mixing"])


def test_run(spark, tmp_path):
    _corpus(spark, str(tmp_path))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "sequence_id", "offset"} <= set(found.columns) and found.count() > 0


def _chain(spark, path, rows, labels):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, cdf string"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = stage(spark, docs, str(path)).collect()
        if name != "packing":
            assert stage(spark, docs, str(path)).columns == [f.split()[0] for f in schema.split(", ")]
            docs = spark.createDataFrame(seen[name], schema)
    return seen


def test_stages_on_nulls_repeats_ties_and_long_texts(spark, tmp_path):
    long = " ".join(f"long{i % 911}x{i % 37}" for i in range(40_000))
    words = [f"w{i}" for i in range(200)]
    near = " ".join([*words[:100], "other", *words[101:]])
    rows = [(None, None, None, None, None, "a", "b"), (1, "", "en", None, 0, "a", "b"), (2, long, "en", "s", 5, "a", "b"), (2, long, "en", "s", 5, "a", "b"), (2, long, "en", "s", 5, "z", "b"), (3, " ".join(words), "en", "s", 5, "a", "b"), (4, near, None, "s", 5, "a", None), (None, "text of no id", "en", "s", 1, None, None), (None, "another of no id", "en", "s", 1, None, None)]
    seen = _chain(spark, tmp_path, rows, [])
    assert len(seen["quality"]) == len(rows)  # without labels nothing is rejected
    exact = sorted((str(r.doc_id), r.text or "") for r in seen["exact dedup"])
    assert exact == sorted([("1", ""), ("2", long), ("3", " ".join(words)), ("4", near), ("None", "another of no id"), ("None", "text of no id")])
    kept = {(r.doc_id, r.text) for r in seen["near dedup"]}
    assert (3, " ".join(words)) in kept and (4, near) not in kept and len(kept) == 5
    assert {r.text for r in seen["mixing"]} <= {t for _, t in kept}
    assert sum(r.length for r in seen["packing"]) > 0 and all(0 < r.length <= 4096 for r in seen["packing"])


def test_stages_on_empty_tables(spark, tmp_path):
    assert all(rows == [] for rows in _chain(spark, tmp_path, [], []).values())
