"""Top-k selection and rank fusion with a total order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.params import RRF_K

#: Scores that agree to as many digits are ties, which ids decide.
DIGITS = 9
#: Rows that a task keeps of a query beyond the k best, as NumPy and the JVM may round a last digit differently.
SPARE = 8


def top_k(scores: DataFrame, score: str, k: int) -> DataFrame:
    """The k best rows of each query_id with their rank from 1: by score, ties by id. None for k of 0 or less."""
    w = Window.partitionBy("query_id").orderBy(F.round(score, DIGITS).desc(), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(k, 0))


def best_rows(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The positions of the rows that are among the k best of their query, with ``SPARE`` more; for what a task has found so
    far, before ``top_k`` makes the choice among the tasks."""
    order = np.lexsort((ids, -np.round(score, DIGITS), query))
    q = query[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k + SPARE]


def fuse(rankings: DataFrame, k: int = RRF_K, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, list_id, rank, id): (query_id, rank, id, rrf, ranks).

    An id counts once in a list, at its first rank; a list without it adds nothing. ranks maps list_id to
    rank. Order: score, then the best rank, then id.
    """
    first = rankings.groupBy("query_id", "id", "list_id").agg(F.min("rank").alias("r"))
    fused = first.groupBy("query_id", "id").agg(
        F.sum(1.0 / (k + F.col("r"))).alias("rrf"), F.min("r").alias("best"), F.map_from_entries(F.collect_list(F.struct("list_id", "r"))).alias("ranks")
    )
    w = Window.partitionBy("query_id").orderBy(F.round("rrf", 12).desc(), "best", "id")
    out = fused.withColumn("rank", F.row_number().over(w))
    return (out if top is None else out.where(F.col("rank") <= top)).select("query_id", "rank", "id", "rrf", "ranks")
