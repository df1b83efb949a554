"""Blocks of neighbours: the same rows as exact search over all, with blocks passed over where vectors lie in clusters."""

import numpy as np
import pytest

from millrace.operators import dense
from millrace.operators.nearest import NearestIndex


def table(spark, x, key, parts=3):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], f"{key} long, embedding array<double>").repartition(parts)


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["cosine"], 9)) for r in df.collect())


@pytest.mark.parametrize("clusters", [30, 0])
def test_same_rows_and_blocks_passed_over(spark, tmp_path, clusters):
    rng = np.random.default_rng(clusters)
    x = rng.standard_normal((2500, 24))
    if clusters:
        x = x * 0.15 + rng.standard_normal((clusters, 24))[rng.integers(0, clusters, 2500)]
    x[7], x[9] = 0, x[8]  # no direction; a tie
    q = np.vstack([x[:40], rng.standard_normal((5, 24)), np.zeros((1, 24))])
    v, asked = table(spark, x, "id"), table(spark, q, "query_id", 2)
    NearestIndex.write(v, str(tmp_path / "i"), rows=50)
    index = NearestIndex.open(spark, str(tmp_path / "i"))
    for k in (1, 10) if clusters else (10,):
        assert rows(index.search(asked, k)) == rows(dense.search(asked, v, k))
    _, first, rest = index.pairs(asked.where("query_id BETWEEN 10 AND 39"), 10)
    looked, all_pairs = first.count() + rest.count(), index.heads.count() * 30
    assert looked < all_pairs / 4 if clusters else looked <= all_pairs


def test_edges(spark, tmp_path):
    v = table(spark, np.eye(3), "id")
    NearestIndex.write(v, str(tmp_path / "i"), rows=1)
    index = NearestIndex.open(spark, str(tmp_path / "i"))
    asked = table(spark, np.eye(3)[:1], "query_id")
    assert rows(index.search(asked, 5)) == [(0, 1, 0, 1.0), (0, 2, 1, 0.0), (0, 3, 2, 0.0)]
    assert index.search(asked, 0).count() == 0 and index.search(asked.limit(0), 5).count() == 0
    NearestIndex.write(v.limit(0), str(tmp_path / "none"))
    assert NearestIndex.open(spark, str(tmp_path / "none")).search(asked, 5).count() == 0
    same = table(spark, np.ones((200, 3)), "id")  # one pivot has all
    NearestIndex.write(same, str(tmp_path / "same"), rows=30)
    assert [r["id"] for r in NearestIndex.open(spark, str(tmp_path / "same")).search(asked, 4).orderBy("rank").collect()] == [0, 1, 2, 3]
