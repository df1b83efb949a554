"""The kept index: the same rows as without blocks, and less read for them."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import blocks as b
from millrace.operators.lexical import LexicalIndex, score_texts


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts of topics that come in stretches, with words that all have."""
    rng = random.Random(7)
    rows = []
    for i in range(6000):
        topic = (i // 300) % 15
        own = [f"t{topic}w{int(rng.expovariate(0.3))}" for _ in range(rng.randrange(0, 25))]
        rows.append((i, " ".join(own + rng.choices(["common", "usual", "rare" if i % 997 == 0 else "often"], k=rng.randrange(0, 6)))))
    return spark.createDataFrame(rows + [(6000, None), (6001, "")], "id long, text string")


@pytest.fixture(scope="module")
def indexes(spark, corpus, tmp_path_factory):
    whole, path = LexicalIndex.build(corpus, "id"), str(tmp_path_factory.mktemp("index") / "i")
    b.BlockIndex.write(whole, path)
    return whole, b.BlockIndex.open(spark, path)


QUERIES = [(1, "t3w0 t3w1 common"), (2, "rare"), (3, "common usual often"), (4, "t5w2 t9w0 nowhere"), (5, "nowhere"), (6, ""), (7, None), (8, "t1w0 t1w0 t1w7")]


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["bm25"], 9)) for r in df.collect())


def test_same_rows_and_statistics(spark, indexes):
    whole, kept = indexes
    q = spark.createDataFrame(QUERIES, "query_id long, text string")
    for k in (1, 7, 50, 5000):
        assert rows(kept.search(q, "query_id", k=k)) == rows(whole.search(q, "query_id", k=k))
    assert kept.search(q, "query_id", k=0).count() == 0 and kept.search(q.limit(0), "query_id").count() == 0
    assert sorted(map(tuple, kept.idf().collect())) == sorted(map(tuple, whole.idf().collect()))
    assert tuple(kept.summary().first()) == tuple(whole.summary().first()) and kept.size_bytes().first() == whole.size_bytes().first()


def test_fewer_postings_are_read(spark, indexes):
    """A topic's words lie in its stretches: others with the common word only are passed over, and stay unread."""
    whole, kept = indexes
    q = spark.createDataFrame(QUERIES[:1], "query_id long, text string")
    weights = kept.weights(q, "query_id")
    _, first, rest = kept.stretches(weights, 10)
    read = kept.postings_of(weights, first.unionByName(rest)).count()
    wanted = whole._wanted(weights).count()
    assert rest.count() + first.count() < kept.heads(weights).count() and read < wanted / 2


def test_terms_go_to_the_scan(spark, indexes):
    kept = indexes[1]
    q = spark.createDataFrame([(1, "rare t3w1")], "query_id long, text string")
    weights = kept.weights(q, "query_id")
    plan = kept.heads(weights)._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_many_terms_are_joined(spark, indexes, monkeypatch):
    whole, kept = indexes
    q = spark.createDataFrame(QUERIES, "query_id long, text string")
    monkeypatch.setattr(b, "PUSHED", 2)
    monkeypatch.setattr(b, "FIRST", 1)
    assert rows(kept.search(q, "query_id", k=7)) == rows(whole.search(q, "query_id", k=7))


def test_texts_are_scored_as_in_the_index(spark, indexes, corpus):
    whole, kept = indexes
    q = spark.createDataFrame(QUERIES, "query_id long, text string")
    _, weights = kept.best(q, "query_id", k=3)
    pairs = q.select("query_id").join(corpus.where("id % 500 < 3"))
    full = {(r["query_id"], r["id"]): r["bm25"] for r in whole.scores(q, "query_id").collect()}
    for r in score_texts(weights, pairs).collect():
        assert r["bm25"] == pytest.approx(full.get((r["query_id"], r["id"]), 0.0), abs=1e-12)


def test_bounds_hold_after_the_corpus_has_changed(spark, indexes):
    """df and lengths from other rows than those that the blocks were written with."""
    whole, kept = indexes
    q = spark.createDataFrame(QUERIES, "query_id long, text string")
    grown = b.BlockIndex(kept.blocks, kept.terms.unionByName(spark.createDataFrame([("rare", 40), ("common", -100)], b.TERMS)), spark.createDataFrame([(9000, 400_000)], b.STATS), lambda r: r.where(F.col("id") % 3 > 0))
    weights = grown.weights(q, "query_id")
    want = grown._scored(weights, grown.heads(weights).select("query_id", "block"))
    best = {}
    for r in want.collect():
        best.setdefault(r["query_id"], []).append((-round(r["bm25"], 9), r["id"]))
    got = {}
    for r in grown.search(q, "query_id", k=7).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {n: [i for _, i in sorted(x)[:7]] for n, x in best.items()}


def test_blocks_of_texts_and_scores_by_stretch(spark, tmp_path, monkeypatch):
    """Made of whole texts and scored by stretch, as made of single postings and scored by these."""
    draw = random.Random(9)
    some = lambda n: " ".join(draw.choice("abcdefghijklmnop") * 2 for _ in range(n))
    rows = [(i, some(draw.randrange(0, 7))) for i in range(1500)] + [(5000, None), (5001, "aa zz")]
    whole = LexicalIndex.build(spark.createDataFrame(rows, "id long, text string").repartition(3), "id")
    b.BlockIndex.write(whole, str(tmp_path / "a"))
    b.BlockIndex.write(LexicalIndex.of(whole.postings, whole.lengths), str(tmp_path / "b"))
    one, two = (b.BlockIndex.open(spark, str(tmp_path / x)) for x in "ab")
    for name in ("blocks", "terms", "stats"):
        assert sorted(map(str, getattr(one, name).collect())) == sorted(map(str, getattr(two, name).collect()))
    q = spark.createDataFrame([(i, some(3)) for i in range(25)] + [(70, "zz"), (71, "nothing"), (72, None)], "query_id long, text string")
    weights = one.weights(q, "query_id")
    wanted = one.heads(weights).select("query_id", "block").where("(query_id + block) % 3 > 0")
    close = lambda found: {(r["query_id"], r["id"], "rank" in found.columns and r["rank"]): round(r["bm25"], 9) for r in found.collect()}
    by_stretch, hits = one._scored(weights, wanted), {k: one.search(q, "query_id", k=k) for k in (0, 1, 7)}
    # Blocks are shuffled, not their postings for each query.
    assert "MapInArrow" in by_stretch._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(b, "ASKED_BYTES", -1)
    assert close(by_stretch) == close(one._scored(weights, wanted)) != {}
    for k, found in hits.items():
        assert close(found) == close(one.search(q, "query_id", k=k)) and (k == 0) == (not found.count())
