"""Hybrid retrieval: lexical and dense rankings, fused and hydrated."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.params import DEPTH
from millrace.functions.staging import stage, unstage
from millrace.operators import dense, metrics
from millrace.operators.blocks import BlockIndex
from millrace.operators.lexical import LexicalIndex, score_texts
from millrace.operators.ranking import fuse


class Embedder(Protocol):
    """Makes unit vectors (id, embedding) of texts. A model goes here, as a function over ``mapInArrow`` or a
    pandas UDF."""

    def __call__(self, docs: DataFrame, key: str) -> DataFrame: ...


@dataclass(frozen=True)
class Corpus:
    """Chunks (id, doc, page, text) with their lexical index and vectors."""

    chunks: DataFrame
    lexical: LexicalIndex | BlockIndex
    vectors: DataFrame
    embed: Embedder = dense.hash_embeddings

    @staticmethod
    def build(chunks: DataFrame, embed: Embedder = dense.hash_embeddings) -> Corpus:
        """Chunks, terms and vectors are staged, as several branches of every query read them; ``release`` deletes them."""
        held = stage(chunks, "chunks")
        return Corpus(held, LexicalIndex.build(held, "id"), stage(embed(held, "id"), "vectors"), embed)

    def release(self) -> None:
        if isinstance(self.lexical, LexicalIndex):
            self.lexical.release()
        unstage(self.chunks, self.vectors)

    def _asked(self, queries: DataFrame) -> DataFrame:
        return stage(self.embed(queries, "query_id").withColumnRenamed("id", "query_id"), "asked")

    def _parts(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """The k best by words, the weights of the queries' terms, the k best by vectors, and the queries' vectors."""
        asked = self._asked(queries)
        return *self.lexical.best(queries, "query_id", k=k), dense.search(asked, self.vectors, k), asked

    def ranking(self, queries: DataFrame, mode: str, k: int = 10, depth: int = DEPTH) -> DataFrame:
        """(query_id, rank, id) by mode: 'bm25', 'dense' or 'hybrid'."""
        if mode not in ("bm25", "dense", "hybrid"):
            raise ValueError(f"no such mode: {mode}")
        best_s, _, best_d, _ = self._parts(queries, depth if mode == "hybrid" else k)
        if mode != "hybrid":
            return (best_s if mode == "bm25" else best_d).select("query_id", "rank", "id")
        return self._fused(best_s, best_d, k).select("query_id", "rank", "id")

    def rankings(self, queries: DataFrame, k: int = 10, depth: int = DEPTH) -> DataFrame:
        """(mode, query_id, rank, id) of all modes, from one pair of score tables."""
        best_s, _, best_d, _ = self._parts(queries, max(k, depth))
        best_s, best_d = stage(best_s, "by-words"), stage(best_d, "by-vectors")
        lists = {"bm25": best_s.where(F.col("rank") <= k), "dense": best_d.where(F.col("rank") <= k), "hybrid": self._fused(best_s.where(F.col("rank") <= depth), best_d.where(F.col("rank") <= depth), k)}
        parts = [r.select(F.lit(mode).alias("mode"), "query_id", "rank", "id") for mode, r in lists.items()]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def evaluate(self, queries: DataFrame, qrels: DataFrame, modes: tuple[str, ...] = ("dense", "bm25", "hybrid"), k: int = 10) -> DataFrame:
        """(mode, query_id, first_rank, rr, dcg, ndcg, ms) of every query in every mode, for ``metrics.report``. Each mode is run and
        timed by itself; ms is its share of the batch's time, the same for all queries of a mode."""
        n, out = queries.count(), []
        for mode in modes:
            began = time.perf_counter()
            ranked = stage(self.ranking(queries, mode, k), f"by-{mode}")
            ms = 1000 * (time.perf_counter() - began) / max(1, n)
            out.append(metrics.per_query(queries, ranked, qrels, k).select(F.lit(mode).alias("mode"), "*", F.lit(ms).alias("ms")))
        return reduce(DataFrame.unionByName, out)

    def _fused(self, best_s: DataFrame, best_d: DataFrame, k: int) -> DataFrame:
        lists = [r.select("query_id", F.lit(i).alias("list_id"), "rank", "id") for i, r in ((0, best_d), (1, best_s))]
        return fuse(lists[0].unionByName(lists[1]), top=k)

    def passages(self, queries: DataFrame, k: int = 5, depth: int = DEPTH) -> DataFrame:
        """The k best passages of each query (query_id, text) with all their scores and ranks.

        Cosine and BM25 are those of the whole corpus, also for a passage that only one list has.
        """
        best_s, weights, best_d, asked = self._parts(queries, depth)
        # Few rows: their texts, vectors and words are looked up for them alone.
        hits = stage(self._fused(best_s, best_d, k), "hits")
        out = score_texts(weights, dense.cosines(hits, asked, self.vectors).join(self.chunks, "id"))
        return out.select(
            "query_id", "rank", F.col("id").alias("chunk_id"), "doc", "page", "text", "rrf", F.col("cosine").alias("dense"), "bm25",
            F.try_element_at("ranks", F.lit(0)).alias("dense_rank"), F.try_element_at("ranks", F.lit(1)).alias("bm25_rank"),
        )
