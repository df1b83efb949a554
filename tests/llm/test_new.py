"""Quality scores and spelling variants: plain versions without Spark, held-out accuracy, odd tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import op11_classifier as q
from millrace.llm import op12_variants as v

DOCS = "doc_id long, text string"


# Spelling variants


def plain_words(rows):
    counts = Counter()
    for d, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in r)
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            if h % 31 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            if len(r) >= 7:
                counts[r] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    n = plain_words(rows)
    by_hole = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            by_hole[w[:i] + "*" + w[i + 1 :]].add(w)
            by_hole[w[:i] + w[i + 1 :]].add(w)
        by_hole[w].add(w)
    others = {w: set() for w in n}
    for group in by_hole.values():
        for w in group:
            others[w] |= {x for x in group if near(w, x)}
    form = {w: min(x, key=lambda y: (-n[y], y)) for w, x in others.items() if x}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(others[w]), n[form[w]] if w in form else None))
    return out


def got_variants(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("letters", ["ab", "aéÿ", "abcdefgh"])
def test_automata_and_tries(letters):
    """All pairs of small alphabets: runs of equal letters, words that begin others, the same word."""
    rng = random.Random(len(letters))
    words = sorted({"".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(400)})
    asked = words + ["".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(50)]
    trie = v.Trie.of(words, list(range(len(words))))
    raw = [w.encode("latin-1") for w in asked]
    a, b = v.Neighbours(trie, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])).pairs()
    assert sorted(zip(a.tolist(), b.tolist())) == [(i, j) for i, x in enumerate(asked) for j, y in enumerate(words) if near(x, y)]


def test_variants_against_all_pairs(spark):
    """Chains of forms, ties of counts, mixed case, letters beyond ASCII, signs and digits that end runs."""
    rng = random.Random(3)
    stems = ["".join(rng.choices("abcdé", k=rng.randrange(6, 10))) for _ in range(60)]
    rows = []
    for d in range(300):
        words = []
        for _ in range(40):
            w = stems[min(len(stems) - 1, int(rng.expovariate(0.15)))]
            if rng.random() < 0.2:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + "a" + w[i:], w[:i] + "b" + w[i + 1 :], w.upper(), w.title()])
            words.append(w)
        rows.append((d, rng.choice([" ", "-", "1", "_", "Ā"]).join(words)))
    rows += [(1000 + i, "longestone " * 10 ** (i % 3) + "longestonf longestonf") for i in range(3)]
    rows += [(2000 + i, "chainword " * 100 + "chainworde " * 6 + "chainwordeé" * (i < 4)) for i in range(10)]
    df = spark.createDataFrame(rows, DOCS)
    want = plain_variants(rows)
    assert got_variants(v.variants(df)) == want and any(r[1] and r[2] != r[1] for r in want) and sum(r[4] for r in want) > 100
    words = v.count_words(df)
    whole = {tuple(r) for r in v.near_words(words).collect()}
    assert whole == {tuple(r) for r in v.near_words(words, shard_words=7, broadcast_bytes=1).collect()} == {tuple(r) for r in v.near_words(words, shard_words=30, broadcast_bytes=60_000).collect()}


def test_variants_of_odd_tables(spark):
    assert v.variants(spark.createDataFrame([], DOCS)).collect() == []
    assert v.variants(spark.createDataFrame([(1, None), (2, ""), (3, "short words only"), (None, None)], DOCS)).collect() == []
    long = "Ab" * 1_000
    rows = [(1, long), (2, long + "c"), (3, long), (4, long + "c"), (None, "repeated repeated"), (5, "repeated"), (5, "repeated"), (6, "a" * 6 + " " + "ÀÉ" * 4), (7, "ÀÉ" * 4)]
    more = [(d, t, "x", 1) for d, t in rows]
    assert got_variants(v.variants(spark.createDataFrame(more, DOCS + ", n string, word int"))) == plain_variants(rows)


def test_query_of_variants(spark):
    at = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    assert got_variants(v.op12_variants(spark, at)) == plain_variants(rows)


# Quality scores


def test_context_vectors_against_sums_word_by_word(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["red", "RED", "blue!!", "x1", "é", "|"], k=rng.randrange(0, 12))) for _ in range(60)] + ["", None, "one"]
    places, signs = q.index_vectors()
    want = np.zeros((q.BUCKETS, q.DIMS + 1), np.int64)
    for t in texts:
        rows = [zlib.crc32(w.encode()) % q.BUCKETS for w in re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", t or "")]
        for i, r in enumerate(rows):
            want[r, q.DIMS] += 1
            for j in range(max(0, i - q.NEAR), min(len(rows), i + q.NEAR + 1)):
                if j != i:
                    for e in range(q.ENTRIES):
                        want[r, places[rows[j], e]] += signs[rows[j], e]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert (q.context_sums(df) == want).all()


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"word{i} {'=' * (i % 7)}" for i in range(500)) + "  " + "q" * 300
    whole = q.word_rows(text)
    for size in (1, 7, 100):
        monkeypatch.setattr(q, "SLICE", size)
        assert (q.word_rows(text) == whole).all()


def test_temperature():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert q.temperature(z * 3, y) == pytest.approx(3, rel=0.15) and q.temperature(z / 4, y) == pytest.approx(0.25, rel=0.15)
    sure = np.array([1.0, 1, 1, 0, 0])
    assert math.isfinite(q.temperature(sure * 20 - 10, sure))


def test_held_out_accuracy_and_calibration(spark, sf):
    rows = [r for r in q.op11_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 80 and sum(r["predicted"] == r["quality"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert abs(sum(r["score"] for r in held) - sum(r["quality"] for r in held)) < 0.05 * len(held)


def test_scores_follow_from_texts_alone(spark, sf):
    """Neither ids, languages and sources nor labels of rows that are held out change a score."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    first = {r["doc_id"]: r["score"] for r in q.classify(docs, labels).collect()}
    wrong = labels.withColumn("quality", q.F.when(q.is_held_out(q.F.col("doc_id")), 1 - q.F.col("quality")).otherwise(q.F.col("quality")))
    again = q.classify(docs.repartition(5).withColumn("lang", q.F.lit("x")).drop("source"), wrong)
    assert {r["doc_id"]: r["score"] for r in again.collect()} == first


def test_scores_of_odd_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert q.classify(spark.createDataFrame([], DOCS), labels).collect() == []
    rows = [(1, None), (2, ""), (None, "some text"), (3, "word " * 300_000), (3, "word " * 300_000), (4, "clean words stand here")]
    out = q.classify(spark.createDataFrame(rows, DOCS), labels).collect()
    assert len(out) == 6 and {r["score"] for r in out} == {0.5} and {r["predicted"] for r in out} == {1}
    taught = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(4, 1), (None, 0), (5, 7), (6, None)], "doc_id long, quality int")
    rows = [(i, "bad ## bad ## bad" if i % 2 == 0 else "a few good words") for i in range(40)] + [(None, None), (7, ""), (7, "a few good words")]
    more = [(d, t, 9, "kept") for d, t in rows]
    out = q.classify(spark.createDataFrame(more, DOCS + ", score int, mr_text string"), taught)
    assert sorted(out.columns) == ["doc_id", "held_out", "mr_text", "predicted", "score", "text"]
    got = out.collect()
    assert len(got) == 43 and all(r["mr_text"] == "kept" and 0 <= r["score"] <= 1 for r in got)
    assert all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in got if r["text"] and r["doc_id"] is not None)
    one = q.classify(spark.createDataFrame(rows, DOCS), taught.where("quality = 1")).collect()
    assert len({r["score"] for r in one}) == 1 and one[0]["score"] > 0.9
