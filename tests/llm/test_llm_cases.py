"""Cases that a review found: clashing columns, repeated rows, ties, shared folders, independent brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("helixframe.llm")
from pyspark.sql import functions as F  # noqa: E402

from helixframe.llm import common, edit_fingerprint, exact_dedup, license_scan, mixing, pii, quality, sharding, simhash  # noqa: E402

CLASH = ["__id", "__hash", "__u", "__source", "__spans", "__removed", "row", "cdf", "rate", "copies", "copy", "shuffle_key", "id", "row_hash", "h", "sha", "key", "node", "keep_id", "text_hash", "clean", "name", "u", "group"]


def clashing(spark, texts):
    rows = [(i if i != 4 else None, t, "en", f"s{i % 2}", len(t or "")) + tuple(f"{c}{i}" for c in CLASH) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH))


TEXTS = [None, "", "one two three four five six", "ONE two three four five six", "mail me: bob quimby x@y.example now", "x" * 5000, "one  two three four five six"]


def test_columns_of_any_name_pass_through(spark):
    df = clashing(spark, TEXTS)
    source = {r["id"]: tuple(r) for r in df.collect()}
    for found in (simhash.near_dedup(df), exact_dedup.exact_dedup(df), mixing.mix(df).select(df.columns), quality.keep_good(df, quality.Model({}, 1.0))):
        rows = found.collect()
        assert found.columns == df.columns and rows and all(tuple(r) == source[r["id"]] for r in rows)
    clean = pii.sanitise(df).collect()
    assert len(clean) == len(TEXTS)
    for r in clean:
        assert tuple(r)[2:] == source[r["id"]][2:] and ("[EMAIL]" in r["text"]) == (r["id"] == "id4")
    for found in (exact_dedup.exact_groups(df), simhash.near_groups(df), quality.score(df, quality.Model({}, 1.0)), edit_fingerprint.edited_neighbours(df), pii.find(df), sharding.shard(df), license_scan.scan_licenses(df)):
        assert found.count() == len(TEXTS)


def test_repeated_rows_and_ids(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [(1, " ".join(words), "a"), (1, " ".join(words), "b"), (1, " ".join(words[:59]), "c"), (2, " ".join(words), "d"), (7, "other text here", "e"), (7, "and one more", "f"), (None, "null one", "g"), (None, "null two", "h"), (None, "null two", "h")]
    df = spark.createDataFrame(texts, "doc_id long, text string, mark string")
    for part in (1, 3, 9):
        kept = sorted((str(r.doc_id), r.text) for r in simhash.near_dedup(df.repartition(part)).collect())
        assert len(kept) == 5 and [k for k in kept if k[0] != "1"] == [("7", "and one more"), ("7", "other text here"), ("None", "null one"), ("None", "null two")]
        marks = {r.mark for r in exact_dedup.exact_dedup(df.repartition(part)).collect()}
        first = marks if part == 1 else first  # noqa: F821
        assert marks == first and len(marks) == 6


def test_a_cluster_needs_a_shared_folder(spark):
    found = common.shared_dir(spark)
    assert found == spark.conf.get("spark.checkpoint.dir").rstrip("/")

    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "local-cluster[2,1,1024]"

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)


def test_exact_numbering_whatever_the_chunks(spark):
    df = common.materialize(spark.range(3000).select((F.col("id") % 3).alias("g"), "id"), "rows")
    for chunks in (1, 7, 500):
        found = common.number_within(df, ["g"], F.pmod(F.xxhash64("id"), F.lit(chunks)), ["id"], "n").collect()
        slots = defaultdict(list)
        for r in found:
            slots[r.g].append(r.n)
        assert all(sorted(v) == list(range(1000)) for v in slots.values())


# --- op4: an independent forward pass, numeric gradients, every passage


def slow_features(data):
    n = max(1, -(-len(data) // quality.PASSAGE))
    data = data + b"\n" * (3 - len(data)) if len(data) < 3 else data
    kind, rows = quality._classes(), []
    low = [b + 32 if 65 <= b <= 90 else b for b in data]
    for p in range(n):
        own = range(p * quality.PASSAGE, min(len(data), (p + 1) * quality.PASSAGE) if p < n - 1 else len(data))
        pairs = Counter(kind[data[i - 1]] * quality.CLASSES + kind[data[i]] for i in own if i >= 1)
        grams = Counter(((low[i - 2] * 0x9E3779B1 + low[i - 1] * 0x85EBCA77 + low[i] * 0xC2B2AE3D) >> 7) % quality.HASHED for i in own if i >= 2)
        share = [pairs[k] / len(own) for k in range(quality.CLASSES**2)] + [grams[k] / len(own) for k in range(quality.HASHED)]
        tail = share[quality.CLASSES**2 :]
        share += [4 * sum(x * x for x in tail), max(tail)]
        rows.append([math.sqrt(x * len(own) / (len(own) + quality.SMOOTH)) for x in share])
    return rows


def test_quality_features_and_score_like_a_slow_form(monkeypatch):
    import numpy as np

    rng = random.Random(3)
    texts = [b"", b"a", "é ß 😀".encode(), bytes(rng.randrange(32, 127) for _ in range(384)), bytes(rng.randrange(32, 127) for _ in range(2500))]
    w = quality.initial()
    for block in (quality.BLOCK, 2):
        monkeypatch.setattr(quality, "BLOCK", block)
        for data in texts:
            slow = slow_features(data)
            assert np.allclose(np.concatenate(list(quality.blocks(data))), slow, atol=1e-3)
            h = [[math.tanh(sum(x * w["e"][i][k] for i, x in enumerate(row)) + w["eb"][k]) for k in range(quality.EMBED)] for row in slow]
            gate = [[math.tanh(sum(r[k] * w["v"][k][j] for k in range(quality.EMBED))) / (1 + math.exp(-sum(r[k] * w["u"][k][j] for k in range(quality.EMBED)))) for j in range(quality.ATTEND)] for r in h]
            weight = [math.exp(sum(g[j] * w["a"][j] for j in range(quality.ATTEND))) for g in gate]
            z = [sum(a * r[k] for a, r in zip(weight, h, strict=True)) / sum(weight) for k in range(quality.EMBED)]
            assert abs(quality.Model(w).score(data) - 1 / (1 + math.exp(-sum(z[k] * w["s"][k] for k in range(quality.EMBED)) - w["sb"]))) < 2e-3


def test_quality_gradients_are_the_slopes_of_the_loss():
    import numpy as np

    rng = np.random.default_rng(1)
    bags = [rng.random((n, quality.WIDTH)) for n in (1, 4, 2)]
    y, w = np.array([1.0, 0.0, 1.0]), quality.initial()
    _, grad = quality.gradients(w, bags, y)
    for k in w:
        for _ in range(4):
            at = tuple(int(rng.integers(n)) for n in w[k].shape)
            up, down = ({x: v.copy() if isinstance(v, np.ndarray) else np.array(v) for x, v in w.items()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            slope = (quality.gradients(up, bags, y)[0] - quality.gradients(down, bags, y)[0]) / 2e-5
            assert abs(slope - np.asarray(grad[k])[at]) < 1e-7 + 1e-4 * abs(slope), k


def test_quality_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda bags, labels: seen.append([len(b) for b in bags]) or quality.Model({}, 0.5))
    texts = [(i % 20, "y" * (384 * (1 + i % 20))) for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    able = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1]
    quality.fit(df, labels)
    assert sorted(seen[-1]) == [1 + i for i in able]  # every passage, repeated ids once
    quality.fit(df, labels, limit=2)
    assert len(seen[-1]) == 2
    quality.fit(df, labels, most_bytes=384 * 20)
    assert 1 <= sum(seen[-1]) <= 20


# --- op6: the whole method by plain loops


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def slow_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m.group())) <= 15]
    return out


def test_pii_base_spans_like_the_patterns():
    rng = random.Random(9)
    pieces = ["4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0255.000.1.09", "+1 (212) 555-0100", "+12", "+4930123456789012", "a@b.c", "x.y%z@mail.example.org", "é", " ", "-", ".", "+", "7", "00", "(", "@", "word"]
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert pii.base_spans(t) == slow_base(t), t


def test_pii_long_runs_take_linear_time():
    import time

    start = time.perf_counter()
    pii.base_spans("1" * 300_000 + " " + "1." * 100_000 + "+" * 100_000 + "a@" * 100_000)
    assert time.perf_counter() - start < 20


def slow_terms(rows):
    """Spans of kind term by row, with counts over rows by plain loops."""
    term = re.compile(r"[^\W_]+")
    total, with_term, with_entity, together, contexts = len(rows), Counter(), Counter(), Counter(), defaultdict(set)
    for text in rows:
        with_term.update({w.lower() for w in term.findall(text)})
        pairs, entities = set(), set()
        for kind, s, e in slow_base(text):
            left, right = [w.lower() for w in term.findall(text[:s])][-pii.WINDOW :], [w.lower() for w in term.findall(text[e:])][: pii.WINDOW]
            entities.add((kind, text[s:e]))
            for w in {*left, *right}:
                pairs.add(((kind, text[s:e]), w))
                contexts[(kind, text[s:e]), w].add((tuple(left), tuple(right)))
        with_entity.update(entities)
        together.update(pairs)
    revealing = {}
    for (entity, w), n in together.items():
        c, t, k = with_entity[entity], with_term[w], len(contexts[entity, w])
        if c == total:
            continue
        value = math.log2(n * total / (t * c)) / math.log2(total / c)
        factorial = math.lgamma(k + 1) if k <= 20 else k * math.log(k) - k
        if value >= pii.GENERALISE and k * math.log(t * c / total) - factorial <= math.log(pii.CHANCE):
            revealing[w] = max(value, revealing.get(w, 0))
    return [[(m.start(), m.end()) for m in term.finditer(text) if m.group().lower() in revealing] for text in rows], revealing


def test_pii_terms_like_plain_loops(spark):
    rng = random.Random(12)
    mails, names = [f"user{i}@mail.example.org" for i in range(12)], [f"name{i}" for i in range(12)]
    rows = []
    for i in range(400):
        words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.randrange(3) if i % 4 == 0 else 0):
            k, at = rng.randrange(12), rng.randrange(len(words))
            words[at:at] = [names[k] if rng.random() < 0.8 else "someone", "mail" if rng.random() < 0.5 else "write", mails[k]]
        if rng.random() < 0.05:
            words.append(rng.choice(names))
        rows.append(" ".join(words))
    rows += rows[:20]
    spans, revealing = slow_terms(rows)
    found = pii.find(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")).collect()
    assert 0 < sum(map(len, spans)) and len(revealing) > 5
    for r in found:
        got = [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("term:")]
        assert got == spans[r.id], rows[r.id]
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in slow_base(rows[r.id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_pii_counts_rows_and_not_windows(spark):
    """A term near the entity in one of its four rows (three windows there) and in three rows without it is not revealing."""
    filler = lambda i: " ".join(f"w{(i * 7 + k * k) % 40}" for k in range(30))
    mail = "z@mail.example.org"
    texts = [" ".join(f"{filler(i)} odd {mail}" for i in range(3)), *(f"{filler(i)} {mail} {filler(i + 1)}" for i in range(3)), *(f"{filler(i)} odd {filler(i)}" for i in range(3)), *map(filler, range(200))]
    found = {r.id: r.spans for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert "term:" not in found[4]


# --- op9 and op10 by plain code


def test_sharding_like_plain_code(spark):
    def bid(key, shard, weight):
        return weight / -math.log((int(hashlib.md5(f"{key}|{shard}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)

    weights = [1.0, 2.5, 0.0, 1.0, 0.5]
    texts = ["", None, "é 😀", *(f"text {i}" * (i % 7) for i in range(500))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (5, "again")]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), weights).collect()
    expected = Counter()
    for i, t in rows:
        key, data = "null" if i is None else i, (t or "").encode()
        best = lambda w: max((bid(key, k, x), k) for k, x in enumerate(w) if x > 0)[1]  # noqa: E731, B023
        expected[i, len(data) + 1, zlib.crc32(data), best(weights), best([*weights, 1.0])] += 1
    assert Counter((r.id, r["size"], r.text_crc32, r["shard"], r.grown_shard) for r in found) == expected
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and 2 not in slots


def as_regex(wording):
    """A template as a regular expression over words that each end in a space."""
    out = ""
    for part in re.findall(r"<<[^>]+>>|[^<\s]+", wording):
        if part == "<<optional>>":
            out += "(?:"
        elif part == "<</optional>>":
            out += ")?"
        elif part.startswith("<<var:"):
            low, high = part[6:-2].split(":")
            out += f"(?:[^ ]+ ){{{low},{high}}}"
        elif part.startswith("<<one:"):
            out += f"(?:{part[6:-2]}) "
        else:
            out += f"{part} "
    return re.compile(out)


def test_license_scan_like_regular_expressions():
    rng = random.Random(6)
    templates = (("t1", "a b", "x a b <<optional>>c d<</optional>> <<one:e|f>>"), ("t2", "b a", "<<optional>>c<</optional>> b a <<var:0:2>> d"), ("t3", "c c c", "c c c"))
    for _ in range(3000):
        words = [rng.choice("abcdefx") for _ in range(rng.randrange(1, 40))]
        found = {(m[0], m[1]) for m in license_scan.scan(" ".join(words), templates)["matches"]}
        labels = set()
        for label, _, wording in templates:
            if any(as_regex(wording).match("".join(f"{w} " for w in words[i:])) for i in range(len(words))):
                labels.add(label)
        assert {m[0] for m in found} == labels, words


def test_license_base_places_like_plain_code():
    rng = random.Random(7)
    vocabulary = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "é", "GNU", "License", "x"]
    for _ in range(2000):
        text = rng.choice([" ", "-", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randrange(30)))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({i: i + 32 for i in range(65, 91)}))
        expected = sorted((i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        found = license_scan.scan(text)
        assert (found["n_words"], found["base"]) == (len(words), expected)


def test_batches_of_text_are_bounded(spark, tmp_path):
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.range(1).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get(rows), spark.conf.get(size)
    try:
        for given, expected in ((("-1", "64m"), (common.BATCH_ROWS, common.BATCH_BYTES)), (("50", "1m"), (50, "1m"))):
            spark.conf.set(rows, given[0])
            spark.conf.set(size, given[1])
            common.table(spark, str(tmp_path), "documents")
            assert int(spark.conf.get(rows)) == expected[0] and spark.conf.get(size).rstrip("b") in (str(expected[1]), "1m", "1048576")
    finally:
        spark.conf.set(rows, before[0])
        spark.conf.set(size, before[1])
