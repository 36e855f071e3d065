"""Quality classifier: gated attention over the passages of a document (multiple-instance learning).

A document is a bag of passages, consecutive windows of PASSAGE UTF-8 bytes over its whole text. A passage
is encoded by frequencies of pairs of neighbouring character classes and of hashed character trigrams, and by how
much the trigrams repeat. One layer turns that into an embedding; gated attention (Ilse et al.
2018) weighs the passages of a document by a softmax learned from document labels alone, and a logistic
unit scores the weighted mean. A short bad part of a long text can thus decide.

Training uses a bounded sample of labelled documents: TRAIN_DOCS of them, smallest hash of the id first, as far as their
texts hold TRAIN_BYTES together. Every passage of a chosen document is encoded. The model has a few thousand numbers
and is sent with the tasks. Training and scoring read every passage by the same code, in bounded blocks that carry the
last bytes of the block before, and scoring folds the blocks into a running softmax, so a very long text needs no more
memory than a short one and scores the same whatever the block. No label, language, source or id enters a score.

Defined cases: a null text counts as empty and an empty text is one empty passage, scored like any other;
repeated rows get equal scores, and of rows that repeat an id the smallest text is the one learned from; labels that are
null are ignored, several labels of a document are averaged; without labels of both kinds every score is the share of
good labels (0.5 without labels); ties at score `least` count as good; an empty table gives no rows; other columns,
whatever their names, are not read and pass through `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import materialize, table, text_of

PASSAGE, BLOCK = 384, 2048
TRAIN_DOCS, TRAIN_BYTES = 4000, 32 << 20
CLASSES, HASHED = 14, 256
WIDTH = CLASSES * CLASSES + HASHED + 2
EMBED, ATTEND, EPOCHS, BATCH, SEED = 24, 12, 30, 128, 5
SMOOTH, DECAY = 32, 1e-3  # chosen on a split of the rows that may be trained on


@cache
def _classes():
    """The class of each byte: letters by case, digits, blanks, kinds of punctuation, bytes of other alphabets."""
    import numpy as np

    kind = np.zeros(256, dtype=np.int64)
    kind[ord("a") : ord("z") + 1] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    for group, chars in enumerate((" ", "\n\r\t", ".", ",;:", "!?", "|", "#$%&*@^~", "'\"()[]{}<>", "-_/\\+="), start=4):
        kind[[ord(c) for c in chars]] = group
    kind[128:] = 13
    return kind


def encode(data: bytes, before: bytes = b""):
    """Half-precision features (passages, WIDTH) of the bytes, cut at PASSAGE bytes; before holds up to two bytes that precede them.

    A pair or trigram belongs to the passage of its last byte.
    """
    import numpy as np

    n = max(1, -(-len(data) // PASSAGE))
    if len(before) + len(data) < 3:
        data = data + b"\n" * (3 - len(before) - len(data))
    raw = np.frombuffer(before + data, dtype=np.uint8).astype(np.int64)
    skip = len(before)
    at = np.minimum((np.arange(len(raw)) - skip) // PASSAGE, n - 1)
    kind = _classes()[raw]
    first, second = max(1, skip), max(2, skip)
    pairs = np.bincount(at[first:] * CLASSES * CLASSES + kind[first - 1 : -1] * CLASSES + kind[first:], minlength=n * CLASSES * CLASSES).reshape(n, -1)
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    grams = ((low[second - 2 : -2] * 0x9E3779B1 + low[second - 1 : -1] * 0x85EBCA77 + low[second:] * 0xC2B2AE3D) >> 7) % HASHED
    hashed = np.bincount(at[second:] * HASHED + grams, minlength=n * HASHED).reshape(n, -1)
    size = np.maximum(np.bincount(at[skip:], minlength=n), 1)[:, None]
    share = np.concatenate([pairs, hashed], axis=1) / size
    same = share[:, CLASSES * CLASSES :]
    found = np.concatenate([share, 4 * (same * same).sum(axis=1, keepdims=True), same.max(axis=1, keepdims=True)], axis=1)
    return np.sqrt(found * size / (size + SMOOTH)).astype(np.float16)  # a few characters tell little


def blocks(data: bytes) -> Iterator:
    """The features of a whole text, BLOCK passages at a time."""
    step = BLOCK * PASSAGE
    for start in range(0, max(1, len(data)), step):
        yield encode(data[start : start + step], data[max(0, start - 2) : start])


def _sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Weights of the encoder layer, the gated attention and the scoring unit."""

    def __init__(self, weights: dict, prior: float = 0.5):
        self.weights, self.prior = weights, prior

    def score(self, data: bytes) -> float:
        """Score of a whole text; blocks of passages are folded into a running softmax."""
        import numpy as np

        w = self.weights
        if not w:
            return self.prior
        top, total, mean = -np.inf, 0.0, np.zeros(EMBED)
        for found in blocks(data):
            h = np.tanh(found.astype(np.float32) @ w["e"] + w["eb"])
            a = (np.tanh(h @ w["v"]) * _sigmoid(h @ w["u"])) @ w["a"]
            new = max(top, float(a.max()))
            p = np.exp(a - new)
            mean = mean * np.exp(top - new) + p @ h
            total = total * np.exp(top - new) + float(p.sum())
            top = new
        return float(_sigmoid(mean / total @ w["s"] + w["sb"]))


def gradients(w: dict, bags: list, y):
    """Mean log loss of the bags and its gradient by every weight."""
    import numpy as np

    x = np.concatenate(bags).astype(np.float64)
    sizes = np.array([len(b) for b in bags])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    doc = np.repeat(np.arange(len(bags)), sizes)
    h = np.tanh(x @ w["e"] + w["eb"])
    tv, su = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
    a = (tv * su) @ w["a"]
    p = np.exp(a - np.maximum.reduceat(a, first)[doc])
    p /= np.add.reduceat(p, first)[doc]
    z = np.add.reduceat(p[:, None] * h, first)
    out = _sigmoid(z @ w["s"] + w["sb"])
    loss = float(-(y * np.log(out) + (1 - y) * np.log(1 - out)).mean())
    d = (out - y) / len(bags)
    dz = d[:, None] * w["s"]
    dh = p[:, None] * dz[doc]
    dp = (h * dz[doc]).sum(axis=1)
    da = p * (dp - np.add.reduceat(p * dp, first)[doc])
    dt, ds = da[:, None] * w["a"] * su * (1 - tv**2), da[:, None] * w["a"] * tv * su * (1 - su)
    dh += dt @ w["v"].T + ds @ w["u"].T
    dx = dh * (1 - h**2)
    return loss, {"e": x.T @ dx, "eb": dx.sum(axis=0), "v": h.T @ dt, "u": h.T @ ds, "a": (tv * su).T @ da, "s": z.T @ d, "sb": d.sum()}


def initial() -> dict:
    """Random weights; biases are zero."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    shapes = {"e": (WIDTH, EMBED), "eb": (EMBED,), "v": (EMBED, ATTEND), "u": (EMBED, ATTEND), "a": (ATTEND,), "s": (EMBED,), "sb": ()}
    return {k: rng.normal(0, 1 / np.sqrt(s[0]) if len(s) == 2 else 0.1, s) if s and k != "eb" else np.zeros(s) for k, s in shapes.items()}


def train(bags: list, labels: list[float]) -> Model:
    """Adam on the log loss; the weights are averaged over the last quarter of the epochs."""
    import numpy as np

    y = np.array(labels, dtype=np.float64)
    prior = float(y.mean()) if len(y) else 0.5
    if not 0 < prior < 1 or not len(y):
        return Model({}, prior)
    rng, w = np.random.default_rng(SEED), initial()
    m, v, mean = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(3))
    step = taken = 0
    for epoch in range(EPOCHS):
        for pick in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // BATCH)):
            step += 1
            for k, g in gradients(w, [bags[i] for i in pick], y[pick])[1].items():
                g = g + DECAY * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            if epoch >= EPOCHS * 3 // 4:
                taken += 1
                for k in w:
                    mean[k] += w[k]
    return Model({k: x / taken for k, x in mean.items()}, prior)


def held_out(doc_id):
    """Rows that are never trained on: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _bag_batches(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        bags = [np.concatenate(list(blocks(text.encode()))).tobytes() for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary())], ["quality", "bag"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Trains on at most `limit` labelled documents outside the held-out third, with at most `most_bytes` of text together."""
    import numpy as np

    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    picked = known.groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("quality")).orderBy(F.xxhash64("id"), "id").limit(limit)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(picked), "id")  # `limit` rows at most
    sample = materialize(rows.groupBy("id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")), "sample")
    order = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = sample.select("id", F.octet_length("text").alias("bytes")).withColumn("so_far", F.sum("bytes").over(order)).where(F.col("so_far") <= most_bytes)  # `limit` narrow rows
    chosen = sample.join(F.broadcast(fits.select("id")), "id")
    bags = chosen.select("quality", "text").mapInArrow(_bag_batches, "quality double, bag binary").collect()
    bags.sort(key=lambda r: (bytes(r["bag"]), r["quality"]))  # the order of tasks must not matter
    return train([np.frombuffer(r["bag"], dtype=np.float16).reshape(-1, WIDTH) for r in bags], [float(r["quality"] >= 0.5) for r in bags])


def _score_batches(batches: Iterator, model: Model, at: int) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        scores = [model.score(x.encode()) for x in batch.column(at).to_pylist()]
        columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
        names = [n for i, n in enumerate(batch.schema.names) if i != at]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], [*names, "score"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(lambda b: _score_batches(b, model, 1), f"id {kind}, score double")
    return found.select("id", held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _keep_batches(batches: Iterator, model: Model, at: int, least: float) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        texts = batch.column(at).to_pylist()
        yield batch.filter(pa.array([model.score((x or "").encode()) >= least for x in texts], pa.bool_()))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that score at least `least`, with all their columns; nothing is shuffled."""
    at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda b: _keep_batches(b, model, at, least), docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the whole `documents` table, learned from `labels`."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")
