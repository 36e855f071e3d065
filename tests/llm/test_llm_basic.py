"""Each corpus operator on small frames: edge cases, brute force, round trips."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("helixframe.llm")
from pyspark.sql import functions as F  # noqa: E402

from helixframe.llm import chat_format, common, edit_fingerprint, exact_dedup, license_scan, mixing, packing, pii, quality, sharding, simhash  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, copy string, rate string, h string, id string"
TEXTS = [None, "", " ", "a", "a  b", "a\tb", "A b", "the quick brown fox jumps over the lazy dog " * 40, "é ß ñ œ 😀 x", "word " * 30000]


def docs(spark, texts=TEXTS, repeat=True):
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 3}", None, "x", "y", "z", "w", "v") for i, t in enumerate(texts)]
    if repeat:
        rows += [rows[3], rows[-1], (None, "null id", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_groups(spark):
    rows = docs(spark).select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r.doc_id)
    found = exact_dedup.exact_groups(docs(spark)).collect()
    assert len(found) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in found:
        ids = [i for i in by_sha[r.text_sha256] if i is not None]
        assert (r.keep_id, r.group_size, r.kept) == (min(ids, default=None), len(by_sha[r.text_sha256]), r.doc_id == min(ids, default=None))
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_exact_dedup_keeps_one_row_per_text_and_all_columns(spark):
    found = exact_dedup.exact_dedup(docs(spark))
    assert found.columns == docs(spark).columns
    texts = [norm(r.text) for r in found.collect()]
    assert sorted(texts) == sorted({norm(t) for t in [*TEXTS, "null id"]})


def test_exact_collisions_are_told_apart(spark):
    weak = lambda text: F.substring(F.md5(text), 1, 1)  # noqa: E731  four bits: most texts collide
    df = docs(spark, [f"text {i % 50}" for i in range(200)], repeat=False)
    found = exact_dedup.exact_groups(df, hasher=weak)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in found.collect()} == {(i, i % 50, 4) for i in range(200)}


def test_simhash_of_one_text():
    import xxhash

    def slow(text, k=3):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(simhash._LOWER))
        shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
        out = 0
        for bit in range(64):
            if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) > len(shingles):
                out |= 1 << bit
        return out

    for t in [*TEXTS[:9], "One two", "one TWO three", "x y z w x y z w x y z"]:
        assert simhash.simhash(t) == slow(t)


def test_simhash_links_and_components(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base:
        x = b
        for _ in range(rng.randrange(6)):  # chains that drift
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {0, 7, 15, (1 << 64) - 1}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    pairs = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.links(nodes).collect()}
    near = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3}
    assert pairs == near
    parent = {f: f for f in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    edges = spark.createDataFrame(sorted(near), "a long, b long")
    assert {(r.node, r.component) for r in common.components(edges).collect()} == {(f, root(f)) for p in near for f in p}


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {(r.node, r.component) for r in common.components(edges).collect()} == {(i, 0) for i in range(n + 1)}


def test_near_groups(spark):
    found = {r.id: r for r in simhash.near_groups(docs(spark)).collect()}
    assert len(found) == len(TEXTS) + 1
    assert found[0].fp == found[1].fp == found[2].fp == 0 and found[2].component_id == 0
    assert found[4].component_id == found[5].component_id == 4 == found[6].component_id
    assert simhash.near_groups(empty(spark)).count() == 0
    kept = simhash.near_dedup(docs(spark))
    assert kept.columns == docs(spark).columns and {0, 3, 4} <= {r.doc_id for r in kept.collect()}


def test_near_dedup_by_five_word_jaccard(spark):
    import random

    rng = random.Random(8)
    texts = []
    for g in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for edits in range(6):  # one to five changed words: similarities on both sides of 0.8
            words = list(base)
            for at in rng.sample(range(150), edits):
                words[at] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a // 6 * 6, a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    kept = {r.doc_id for r in simhash.near_dedup(docs(spark, texts, repeat=False)).collect()}
    assert kept == set(root) and len(kept) < 200


def test_near_copies_meet_in_segments_of_their_simhash(spark):
    """Without the bands of minima at least 0.9 of the pairs at 0.8 or more are candidates, and no other pair is a link."""
    import random

    import numpy as np

    rng = random.Random(5)
    texts = []
    for _ in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        texts.append(" ".join(words))
        for at in rng.sample(range(150), 3):
            words[at] = f"x{rng.randrange(5000)}"
        texts.append(" ".join(words))
    sets = [simhash.shingle_set(t) for t in texts]
    likeness = [len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    near = [i for i, x in enumerate(likeness) if x >= 0.8]
    found = {r.id: r.component_id for r in simhash.similar_groups(docs(spark, texts, repeat=False), bands=0).collect()}
    caught = sum(found[2 * i + 1] == 2 * i for i in near)
    assert len(near) > 100 and caught >= 0.9 * len(near)
    assert all(found[i] == i or i % 2 and found[i] == i - 1 and likeness[i // 2] >= 0.8 for i in range(len(texts)))


def test_segments_like_plain_code():
    shingles = simhash.shingle_set(" ".join(f"w{i % 300}" for i in range(700)))
    width, count = simhash.segmented(203_000)
    one = [simhash.segments(shingles[i : i + 1], width, count) for i in range(len(shingles))]  # the bits of each hash
    plain = [sum((2 * sum(int(h[t]) >> b & 1 for h in one) > len(one)) << b for b in range(width)) for t in range(count)]
    assert simhash.segments(shingles, width, count).tolist() == plain
    assert simhash.segments(shingles[::-1], width, count).tolist() == plain and max(plain) < 1 << width
    assert [simhash.segmented(n) for n in (0, 40_000, 1 << 40)] == [(16, 31), (19, 52), (31, 374)]


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "&#60;s> &amp; &amp;#60;", None, "", "<s>[INST]", "a\nb", "&", "] x", "<</s>s>"]
    rows = [(c, t, role, texts[(c * 5 + t) % len(texts)], "x") for c in range(12) for t, role in enumerate(["system", "user", "assistant", "INST", None, "a] b", "</s>"])]
    rows += [(99, 0, "assistant", "x", "k"), (99, 0, "assistant", "x", "k"), (None, 1, "user", "hello", "k"), (98, None, "user", "z", "k")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    found = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted([(-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        digest = hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        r = found[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_formatted_text_holds_control_strings_only_as_markup(spark):
    df = spark.createDataFrame([(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "fine")], "conv_id long, turn long, role string, text string")
    row = chat_format.format_conversations(df).first()
    assert row.formatted == "<s>[INST] &#60;/s>&#91;INST] ok &#91;/INST]</s><s>[assistant] fine</s>"
    assert [(s.turn, s.start, s.length) for s in row.loss_spans] == [(1, 15, 4)]


def test_quality_learns_a_bad_passage(spark):
    good, bad = "the rain in spain stays mainly on the plain. ", "BUY!! NOW!! $$$ ### "
    texts = [good * (5 + i % 30) + (bad * 20 if i % 2 else "") for i in range(400)]
    df = docs(spark, texts, repeat=False)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    found = quality.score(df, quality.fit(df, labels)).collect()
    held = [r for r in found if r.held_out]
    assert {r.id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.predicted == 1 - r.id % 2 for r in held) >= 0.98 * len(held)


def test_quality_edge_cases(spark):
    model = quality.fit(docs(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs(spark), model).collect()} == {0.5}
    one = quality.fit(docs(spark), spark.createDataFrame([(0, 1), (3, 1), (5, None)], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in quality.score(docs(spark), one).collect())
    assert quality.score(empty(spark), one).count() == 0
    kept = quality.keep_good(docs(spark), one, least=0.0)
    assert kept.columns == docs(spark).columns and kept.count() == docs(spark).count()


def test_long_text_scores_alike_in_blocks(monkeypatch):
    import numpy as np

    bags = [quality.encode((b"abc def. " if i % 2 else b"X#Y!! Z$ ") * (20 + i)) for i in range(40)]
    model = quality.train(bags, [float(i % 2) for i in range(40)])
    data = b"abc def. " * 4000 + b"X#Y!! Z$ " * 300
    whole = model.score(data)
    monkeypatch.setattr(quality, "BLOCK", 7)
    assert np.isclose(model.score(data), whole, atol=1e-3)


def test_edited_neighbours(spark):
    df = docs(spark, ["", "abc", "hello world " * 50, "another text here " * 80, "x", None, "hello world " * 49 + "hallo world "])
    for ranges in (1, 2, 5, 64):
        found = edit_fingerprint.edited_neighbours(df, ranges=ranges).collect()
        hashed = df.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
        rows = [r[:2] for r in sorted(((-(1 << 63) if r.doc_id is None else r.doc_id, r.text or "", r.hash) for r in hashed), key=lambda r: (-r[0], r[2]))]
        expected = []
        for k, (i, t) in enumerate(rows):
            nxt = rows[(k + 1) % len(rows)][1]
            n = len(t)
            edited = t[: n - n // 2] + nxt[: n // 2]
            f, e, g = (edit_fingerprint.fingerprint(x) for x in (t, edited, nxt))
            expected.append((None if i == -(1 << 63) else i, n, hashlib.sha256(edited.encode()).hexdigest(), f, e, edit_fingerprint.likeness(f, e), edit_fingerprint.likeness(f, g)))
        got = [(r.id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in found]
        assert sorted(got, key=str) == sorted(expected, key=str)
    assert edit_fingerprint.edited_neighbours(empty(spark)).count() == 0


def slow_fingerprint(text):
    """The walks position by position, with fresh minima over all output positions."""
    import numpy as np

    rng = np.random.default_rng(edit_fingerprint.SEED)
    moves = rng.integers(0, 2, size=(edit_fingerprint.WALKS, edit_fingerprint.CLASSES, edit_fingerprint.PERIOD)).astype(bool)
    moves[:, :, -1] = True
    digits = ""
    for w in range(edit_fingerprint.WALKS):
        output, i = [], 0
        while i < len(text):
            output.append(ord(text[i]) + 1)
            kind = (ord(text[i]) * 0x9E3779B1 >> 9) % edit_fingerprint.CLASSES
            i += bool(moves[w, kind, (len(output) - 1) % edit_fingerprint.PERIOD])
        for k in range(w * edit_fingerprint.SAMPLES, (w + 1) * edit_fingerprint.SAMPLES):
            at = max((x for x in edit_fingerprint._records()[k].tolist() if x < len(output)), default=None)
            symbol = output[at] if output else 0
            mixed = (symbol * 0x9E3779B97F4A7C15 % 2**64) ^ ((k + 1) * 0xC2B2AE3D27D4EB4F % 2**64)
            mixed = (mixed ^ (mixed >> 31)) * 0xBF58476D1CE4E5B9 % 2**64
            digits += f"{(mixed >> 40) % 16:x}"
    return digits


def test_edit_walks_like_a_slow_form():
    import random

    rng = random.Random(7)
    texts = ["", "a", "é😀", *("".join(rng.choice("abcdefghij klmnopß😀") for _ in range(rng.randrange(1, 700))) for _ in range(60)), "x" * 9000]
    codes = [edit_fingerprint._codes(t) for t in texts]
    together = [edit_fingerprint._hex(x) for x in edit_fingerprint._samples(codes, edit_fingerprint.walks(codes, [[0] * edit_fingerprint.WALKS] * len(codes)))]
    for t, found in zip(texts, together, strict=True):
        assert found == edit_fingerprint.fingerprint(t) == slow_fingerprint(t)


def test_edit_sample_positions_are_least_of_a_shared_order():
    """Longer prefixes change a sample's position only to a later one, each with the right probability."""
    import numpy as np

    records = edit_fingerprint._records()
    for length in (10, 1000, 100_000):
        at = np.array([max(x for x in row.tolist() if x < length) for row in records])
        assert abs(at.mean() / length - 0.5) < 0.12 and (at < length / 2).mean() < 0.68


def test_edit_fingerprints_follow_edits():
    import random

    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(4000))
    other = "".join(rng.choice("abcdefghij klmnop") for _ in range(4000))
    f = edit_fingerprint.fingerprint(text)
    few = edit_fingerprint.fingerprint(text[:1000] + "zz" + text[1003:3000] + text[3001:])
    assert edit_fingerprint.likeness(f, f) == edit_fingerprint.best_likeness(f, f) == 1
    assert edit_fingerprint.best_likeness(f, few) > 0.8 > 0.4 > edit_fingerprint.best_likeness(f, edit_fingerprint.fingerprint(other))


def test_edit_near_recall_against_edit_distance(spark):
    """Copies with 1 to 5 edits of up to 4 characters for each 1000: at least 0.9 of them are in their source's group, and nothing else is."""
    import random

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randrange(2, 9)))
    vocabulary = [word() for _ in range(2000)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(100, 700))) for _ in range(120)]
    texts, source = list(base), list(range(120))
    for i, t in enumerate(base):
        for _ in range(3):
            for _ in range(rng.choice((1, 2, 5)) * len(t) // 1000 + 1):
                at = rng.randrange(len(t))
                t = t[:at] + rng.choice(("", word()[:4])) + t[at + rng.randrange(4) :]
            texts.append(t)
            source.append(i)
    rows = spark.createDataFrame([(i, edit_fingerprint.fingerprint(t)) for i, t in enumerate(texts)], "id long, fingerprint string")
    near = {r.id: r.near_id for r in edit_fingerprint.near_groups(rows).collect()}
    caught = sum(near[i] == source[i] for i in range(120, len(texts)))
    print(caught / (len(texts) - 120))
    assert caught >= 0.9 * (len(texts) - 120)
    assert all(source[near[i]] == source[i] for i in range(len(texts)))


def test_edit_near_groups(spark):
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghij klmnop") for _ in range(3000)) for _ in range(12)]
    texts += [t[:500] + "q" + t[501:] for t in texts[:6]] + texts[:3]
    rows = spark.createDataFrame([(i, edit_fingerprint.fingerprint(t)) for i, t in enumerate(texts)], "id long, fingerprint string")
    found = {r.id: r.near_id for r in edit_fingerprint.near_groups(rows).collect()}
    assert found == {i: (i if i < 12 else i - 12 if i < 18 else i - 18) for i in range(21)}


def test_edit_large_group_gives_few_links(spark, monkeypatch):
    import random

    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(600))
    places = [rng.randrange(600) for _ in range(150)]
    texts = [text[:at] + rng.choice("xyz") + text[at + 1 :] for at in places]
    texts = list(dict.fromkeys(edit_fingerprint.fingerprint(t) for t in texts))
    seen = []
    monkeypatch.setattr(edit_fingerprint, "components", lambda edges: seen.append(edges.count()) or common.components(edges))
    found = edit_fingerprint.near_groups(spark.createDataFrame(list(enumerate(texts)), "id long, fingerprint string")).collect()
    print(seen, len(texts))
    assert {r.near_id for r in found} == {0} and len(found) == len(texts)
    assert sum(seen) <= 6 * len(texts)


def test_op5_groups_near_copies(spark, tmp_path):
    import random

    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefghij klmnop") for _ in range(3000)) for _ in range(8)]
    texts = base + base[:3] + [t + "x" for t in base[:6]]
    docs(spark, texts, repeat=False).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in edit_fingerprint.op5_edit_fingerprint(spark, str(tmp_path)).collect()}
    fps = [edit_fingerprint.fingerprint(t) for t in texts]
    for i, f in enumerate(fps):
        near = [j for j, g in enumerate(fps) if edit_fingerprint.best_likeness(f, g) >= edit_fingerprint.NEAR]
        assert found[i].near_id == min(near)
    assert found[8].near_id == 0 and found[11].near_id == 0 and found[7].near_id == 7


def test_pii_spans():
    text = "mail a.b+c@x-y.co.uk, @no, u@v no@dot. ip 10.0.0.255 256.1.1.1 1.2.3.4.5 card 4111 1111 1111 1111, 4111111111111112 tel +1 (212) 555-0100 +12"
    found = {(k, text[s:e]) for k, s, e in pii.base_spans(text)}
    assert found == {("email", "a.b+c@x-y.co.uk"), ("ip", "10.0.0.255"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (212) 555-0100")}


def test_pii_emails_like_the_pattern():
    import random

    rng = random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choice("ab.@-+ é%_") for _ in range(rng.randrange(30)))
        assert [s[1:] for s in pii.base_spans(t) if s[0] == "email"] == [m.span() for m in pii._EMAIL.finditer(t)], t


def test_pii_revealing_terms(spark):
    filler = lambda i: " ".join(f"w{(i * 7 + k * k) % 40}" for k in range(30))
    texts = [f"{filler(i)} write to zorblatt at z@mail.example.org about {filler(i + 3)}" for i in range(6)]
    texts += [f"{filler(i)} zorblatt was here {filler(i + 1)}" for i in range(1)] + [filler(i) for i in range(300)]
    found = {r.id: r for r in pii.find(docs(spark, texts)).collect()}
    assert all("term:" in found[i].spans and found[i].n_email == 1 for i in range(6))
    at = texts[6].index("zorblatt")
    assert f"term:{at}:{at + 8}" in found[6].spans
    assert all(found[i].spans == "" for i in range(7, 300))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, texts)).collect()}
    assert "zorblatt" not in clean[0] and "[EMAIL]" in clean[0] and clean[50] == texts[50]


def test_pii_terms_beside_an_entity_seen_once(spark):
    filler = lambda i: " ".join(f"w{(i * 7 + k * k) % 40}" for k in range(30))
    texts = [f"{filler(1)} zorblatt z@mail.example.org {filler(4)}", f"{filler(2)} quimby +1 (212) 555-0100 {filler(3)}"] + [filler(i) for i in range(300)]
    found = {r.id: r.spans for r in pii.find(docs(spark, texts)).collect()}
    for i, name in enumerate(("zorblatt", "quimby")):
        at = texts[i].index(name)
        assert f"term:{at}:{at + len(name)}" in found[i].split(",")
    assert all(found[i] == "" for i in range(2, 302))


def test_pii_windows_have_no_character_bound():
    words = [f"{c}{i}" * 50 for c in "lr" for i in range(pii.WINDOW)]
    text = f"skipped {' '.join(words[: pii.WINDOW])} z@mail.example.org {' , '.join(words[pii.WINDOW :])} skipped"
    entities, pairs = pii._windows(text, pii.base_spans(text))
    assert len(entities) == 1 and sorted(p["term"] for p in pairs if p["window"] is None) == sorted(map(pii._hash, words)) == sorted(p["term"] for p in pairs if p["window"])


def test_pii_copies_are_one_piece_of_evidence(spark):
    texts = ["rare words around q@mail.example.org here in this text"] * 10 + [f"plain {i} text" for i in range(100)]
    assert all("term:" not in r.spans for r in pii.find(docs(spark, texts)).collect())
    assert pii.find(docs(spark)).count() == len(TEXTS) + 3 and pii.find(empty(spark)).count() == 0


def test_mixing_rates_and_counts(spark):
    import math

    df = docs(spark, ["x" * (50 if i % 3 else 500) for i in range(3000)], repeat=False).drop("rate", "copy")
    found = mixing.mix(df, {"s0": 1.0, "s1": 1.0, "s2": 2.0}).collect()
    rates = {r.source: r.rate for r in found}
    sizes = defaultdict(int)
    for r in df.collect():
        sizes[r.source] += len(r.text)
    total = sum(sizes.values())
    for s, w in (("s0", 1), ("s1", 1), ("s2", 2)):
        assert math.isclose(rates[s], w * total / (4 * sizes[s]), rel_tol=1e-9)
        got = sum(len(r.text) for r in found if r.source == s)
        assert abs(got - w * total / 4) < 5 * math.sqrt(got) * math.sqrt(500)
    assert None not in rates  # weight 0
    by_doc = defaultdict(set)
    for r in found:
        by_doc[r.doc_id, r.copies].add(r.copy)
    assert all(v == set(range(1, n + 1)) for (_, n), v in by_doc.items())


def test_mixing_edge_cases(spark):
    found = mixing.mix(docs(spark))
    assert found.columns == [*docs(spark).columns, "rate_", "copies", "copy_", "shuffle_key"]
    assert {(r["copy"], r["rate"]) for r in found.collect()} <= {("y", "z"), (None, None)}
    assert mixing.mix(empty(spark)).count() == 0


def test_packing(spark):
    df = docs(spark, [*TEXTS, *["lorem ipsum dolor sit amet " * (k % 170) for k in range(400)]])
    found = packing.pack(df).collect()
    encode = packing.Encoder()
    docs_by_id = defaultdict(list)
    for r in df.collect():
        docs_by_id[r.doc_id].append(r.text or "")
    pieces = sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found)
    expected = []
    for i, texts in docs_by_id.items():
        for t in texts:
            data = b"".join(x.to_bytes(4, "little") for x in encode.tokenizer.encode(t, add_special_tokens=False).ids + [2])
            n = len(data) // 4
            expected += [(str(i), s, min(4096, n - s), zlib.crc32(data[4 * s : 4 * (s + 4096)]), n) for s in range(0, n, 4096)]
    assert pieces == sorted(expected)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r.length for r in found) > 0.95 * 4096 * (len(sequences) - 1)
    assert packing.pack(empty(spark)).count() == 0


def test_encoder_equals_the_tokenizer():
    e = packing.Encoder()
    odd = ["it's don't É é ß ŒUVRE <|endoftext|> a<|startoftext|>b ab12c 1,234 Σας ΣΑΣ İx   a\tb\r\nc \n\n 😀x ﬁ ½ _a_ a-b (c) x'll Ünï×÷ word'S \x00a\x1fb \x85 ſ", "", " ", "a" * 300, "́ a ́b"]
    for t in [*odd, *[x or "" for x in TEXTS]]:
        assert [int.from_bytes(e(t)[i : i + 4], "little") for i in range(0, len(e(t)), 4)] == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_plan_uses_every_piece_once():
    import random

    rng = random.Random(4)
    for _ in range(20):
        hist = {rng.randrange(1, 65): rng.randrange(1, 200) for _ in range(rng.randrange(1, 30))}
        used = defaultdict(int)
        for parts, times in packing.plan(hist, 64):
            assert sum(parts) <= 64
            for b in parts:
                used[b] += times
        assert used == hist


def test_nnls_meets_the_optimality_conditions():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12)
        x = packing.nnls(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and (g <= 1e-6).all() and (np.abs(g[x > 0]) <= 1e-6).all()


def test_sharding(spark):
    df = docs(spark, [f"text {i}" * (i % 9) for i in range(3000)])
    found = sharding.shard(df).collect()
    assert len(found) == 3003
    slots = defaultdict(list)
    for r in found:
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) < 1.4 * min(map(len, slots.values()))
    first = next(r for r in found if r.id == 9)
    assert (first.size, first.text_crc32) == (1, 0)
    assert sharding.shard(empty(spark)).count() == 0


def test_weighted_shards(spark):
    key = F.col("id")
    counts = {r["s"]: r["n"] for r in spark.range(40000).select(sharding.rendezvous(key, [1.0, 2.0, 1.0]).alias("s")).groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert abs(counts[1] - 20000) < 600 and abs(counts[0] - 10000) < 500


def test_license_scan(spark):
    text = "x Licensed under the Apache License, Version 2.0. MIT-License; CC BY CC BY-NC 4.0 Released under the terms of the\nMIT License!"
    found = license_scan.scan(text)
    assert [label for _, label in found["base"]] == ["apache", "mit", "cc-by", "cc-by", "mit"]
    assert {m[0] for m in found["matches"]} == {"apache-2.0", "cc-by-nc-4.0", "mit-notice"}
    rows = {r.id: r for r in license_scan.scan_licenses(docs(spark, [text, None, "apache licenses", "APACHE LICENSE"])).collect()}
    assert rows[0].labels == "apache,apache-2.0,cc-by,cc-by-nc-4.0,mit,mit-notice" and rows[0].score == 1
    assert (rows[1].n_words, rows[1].n_base, rows[1].first_word, rows[1].base_labels) == (0, 0, None, "")
    assert rows[2].n_base == 0 and (rows[3].n_base, rows[3].first_word, rows[3].last_word, rows[3].score) == (1, 0, 0, 0.5)
    assert license_scan.scan_licenses(empty(spark)).count() == 0


def test_automaton_wording_is_exact():
    a = license_scan.Automaton("one <<optional>>two three<</optional>> <<var:1:2>> <<one:x|y>> end")
    ok = ["one two three a x end", "one a y end", "one a b x end", "one two three a b y end"]
    bad = ["one two a b x end", "one x end", "one a z end", "one a b c x end", "two three a x end"]
    assert all(a.end_from(t.split(), 0) == len(t.split()) for t in ok)
    assert all(a.end_from(t.split(), 0) is None for t in bad)
    for label, anchor, wording in license_scan.all_templates():
        plain = re.sub(r"<<one:([^|>]*)[^>]*>>", r"\1", wording)
        plain = re.sub(r"<<var:(\d+)[^>]*>>", lambda m: "any " * int(m[1]), plain)
        plain = re.sub(r"<<[^>]*>>", "", plain)
        found = license_scan.scan(f"before {plain} after")
        assert label in {m[0] for m in found["matches"]}, label
        words = license_scan.words_of(plain)
        if len(words) > 60:  # one changed word near the end: no label, and a lower score
            found = license_scan.scan(" ".join([*words[:-12], "otherwise", *words[-11:]]))
            assert label not in {m[0] for m in found["matches"]} or "<<optional>>unless" in wording, label
            assert found["partial"] > 0.8 or "<<optional>>unless" in wording, label


def test_later_wording_decides():
    mit = f"{license_scan._MIT_GRANT} {license_scan._MIT_WARRANTY}".replace("<<optional>>including the next paragraph<</optional>>", "").replace("<<var:2:12>>", "the authors or copyright holders")
    assert {m[0] for m in license_scan.scan(mit)["matches"]} == {"mit-text"}
    evil = mit.replace("the software is provided", "the software shall be used for good the software is provided")
    found = license_scan.scan(evil)
    assert not found["matches"] and 0.3 < found["partial"] < 1
    for n, label in (("", "bsd-2-clause"), (license_scan._BSD_NAMES, "bsd-3-clause"), (f"{license_scan._BSD_ADVERTISING} {license_scan._BSD_NAMES}", "bsd-4-clause")):
        text = re.sub(r"<<var:0[^>]*>>", "", f"{license_scan._BSD_GRANT} {n} {license_scan._BSD_WARRANTY}")
        text = re.sub(r"<<var:1[^>]*>>", "the holder", text)
        assert {m[0] for m in license_scan.scan(text)["matches"]} == {label}
