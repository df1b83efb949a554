"""BM25 over a kept index: postings in blocks that are found by their term and passed over where they can't matter.

A block has the postings of one term in a stretch of ``BLOCK`` neighbouring texts, with the largest tf and the smallest dl
among them. As a term's part of a score grows with tf and falls with dl, these two bound it for every text of the
stretch, whatever the corpus has become since the block was written. Stretches are the same for all terms, so the sum of
the bounds of a query's terms bounds every text's whole score there. Blocks lie in the order of terms; the terms of a
batch of queries are known before anything is read, and go to the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from millrace.functions.params import BM25_B, BM25_K1
from millrace.functions.staging import stage
from millrace.functions.tables import map_texts
from millrace.operators.lexical import ASKED_BYTES, LexicalIndex, asked_terms, part_score, weighted
from millrace.operators.ranking import best_rows, top_k

#: Neighbouring texts of a stretch; stretches of each query that are scored first.
BLOCK, FIRST = 256, 8
#: Up to so many different terms of a batch go to the scan as they are; more are joined.
PUSHED = 1000
#: Queries of which a task adds up the scores of a stretch at a time, 8 bytes for each text of it.
MOST_QUERIES = 1 << 14
#: Neighbouring stretches of a term that are written by one task.
DEALT = 1024
BLOCKS = "term string, block long, n int, most_tf long, least_dl int, ids array<bigint>, tfs array<bigint>, dls array<int>"
TERMS, STATS = "term string, df long", "n long, total long"


def make_blocks(postings: DataFrame, *keys: str) -> DataFrame:
    """Blocks of postings (term, block, id, dl, tf; more ``keys`` part them further): a row for each term and stretch that has it."""
    p = F.array_sort(F.collect_list(F.struct("id", "tf", "dl"))).alias("p")
    made = postings.groupBy(*keys, "term", "block").agg(F.count("*").cast("int").alias("n"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"), p)
    return made.select(*keys, "term", "block", "n", "most_tf", "least_dl", *[F.col(f"p.{c}").alias(f"{c}s") for c in ("id", "tf", "dl")])


def _blocks_of_texts(counted: DataFrame) -> DataFrame:
    """``make_blocks`` from texts whose terms lie in one row each (``term_counts``, ids long): the texts of a stretch meet, not their
    single postings."""

    def made(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks().to_batches()[0]
        id_, dl, terms, tfs, block = (rows.column(i) for i in range(5))
        many = pc.list_value_length(terms).to_numpy()
        names = terms.flatten().dictionary_encode()
        code, stretch = names.indices.to_numpy().astype(np.int64), np.repeat(block.to_numpy(), many)
        order = np.lexsort((code, stretch))
        code, stretch = code[order], stretch[order]
        first = np.nonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (stretch[1:] != stretch[:-1])]))[0]
        tf, dls = tfs.flatten().to_numpy()[order], np.repeat(dl.to_numpy(), many)[order]
        ends = pa.array(np.concatenate([first, [len(code)]]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in (np.repeat(id_.to_numpy(), many)[order], tf, dls)]
        heads = [names.dictionary.take(pa.array(code[first])), pa.array(stretch[first]), pa.array(np.diff(ends.to_numpy()), pa.int32()), pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(dls, first))]
        return pa.RecordBatch.from_arrays([*heads, *lists], names=["term", "block", "n", "most_tf", "least_dl", "ids", "tfs", "dls"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            # The last stretch may go on in the next batch.
            block = rows.column(4).to_numpy()
            whole = int(np.searchsorted(block, block[-1]))
            held = rows.slice(whole)
            if whole:
                yield made(rows.slice(0, whole))
        if held is not None:
            yield made(held)

    rows = counted.where(F.size("terms") > 0).select("id", "dl", "terms", "tfs", F.expr(f"id DIV {BLOCK}").alias("block"))
    return map_texts(rows.repartition("block").sortWithinPartitions("block", "id"), run, BLOCKS)


def write_sorted(df: DataFrame, path: str, *order: str) -> None:
    """Write a table in the order of its columns, so that a term's rows lie in few row groups."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


@dataclass(frozen=True)
class BlockIndex:
    """blocks (BLOCKS), terms (term, df; rows of a term add up, and may be negative) and stats (one row: n, total).
    ``live`` makes the rows of the texts that still count, with the ids that they have now, from rows with ids as written."""

    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame
    live: Callable[[DataFrame], DataFrame] = lambda rows: rows

    @staticmethod
    def write(index: LexicalIndex, path: str) -> None:
        """Write an index whose ids are long; neighbouring numbers make a stretch."""
        if index.counted is not None and index.counted.schema["id"].dataType == LongType():
            # Dealt by a hash: ranges would make the blocks twice, once to find their bounds.
            dealt = _blocks_of_texts(index.counted).repartition("term", F.expr(f"block DIV {DEALT}"))
            dealt.sortWithinPartitions("term", "block").write.parquet(f"{path}/blocks")
            df = index.stats.sparkSession.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("term").agg(F.sum("n").alias("df"))
        else:
            postings = index.postings.withColumn("block", F.expr(f"id DIV {BLOCK}"))
            write_sorted(make_blocks(postings), f"{path}/blocks", "term", "block")
            df = index.idf().select("term", "df")
        write_sorted(df, f"{path}/terms", "term")
        index.stats.select(F.col("n").cast("long"), F.col("total").cast("long")).write.parquet(f"{path}/stats")

    @staticmethod
    def open(spark: SparkSession, path: str) -> BlockIndex:
        return BlockIndex(*(spark.read.schema(kind).parquet(f"{path}/{name}") for name, kind in (("blocks", BLOCKS), ("terms", TERMS), ("stats", STATS))))

    def _of(self, rows: DataFrame, asked: DataFrame) -> DataFrame:
        """The rows of the asked terms. Few terms are put into the scan's filter; only their number and they come to the driver."""
        found = [r[0] for r in asked.select("term").distinct().limit(PUSHED + 1).collect()]
        return rows.where(F.col("term").isin(found)) if len(found) <= PUSHED else rows.join(asked.select("term").distinct(), "term", "left_semi")

    def df(self, asked: DataFrame) -> DataFrame:
        """(term, df) of the asked terms: sums over the kept rows, of whatever number of additions and deletions."""
        return self._of(self.terms, asked).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def idf(self) -> DataFrame:
        """(term, df, idf) of every indexed term; no posting is read."""
        df = self.terms.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return df.join(F.broadcast(self.stats), F.lit(True)).select("term", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))

    def summary(self) -> DataFrame:
        """One row: n_docs, vocab_size, avgdl (0 if empty); no posting is read."""
        vocab = self.terms.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").agg(F.count("*").alias("vocab_size"))
        return self.stats.join(vocab, F.lit(True)).select(F.col("n").alias("n_docs"), "vocab_size", F.coalesce(F.try_divide(F.col("total").cast("double"), F.col("n")), F.lit(0.0)).alias("avgdl"))

    def size_bytes(self) -> DataFrame:
        """As ``LexicalIndex.size_bytes``; no posting is read."""
        kept = self.terms.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        sums = kept.agg((F.coalesce(F.sum(F.octet_length("term")), F.lit(0)) + 12 * F.coalesce(F.sum("df"), F.lit(0))).alias("t"))
        return sums.join(self.stats, F.lit(True)).select((F.col("t") + 12 * F.col("n")).alias("index_bytes"))

    def weights(self, queries: DataFrame, key: str, text: str = "text") -> DataFrame:
        """(query_id, term, idf, avgdl) of the queries' terms."""
        asked = stage(asked_terms(queries, key, text), "asked-terms")
        return stage(weighted(asked, self.df(asked), self.stats), "weights")

    def heads(self, weights: DataFrame) -> DataFrame:
        """(query_id, block, bound): what a text of each stretch scores at most. The postings themselves aren't read."""
        rows = self._of(self.blocks.select("term", "block", "most_tf", "least_dl"), weights).join(weights, "term")
        bound = part_score(F.col("idf"), F.col("most_tf"), F.col("least_dl"), F.col("avgdl"))
        return rows.groupBy("query_id", "block").agg(F.sum(bound).alias("bound"))

    def postings_of(self, weights: DataFrame, wanted: DataFrame) -> DataFrame:
        """The postings of the queries' terms in the wanted stretches (query_id, block), with the terms' weights. Blocks meet the
        stretches before they are unpacked."""
        need = wanted.join(weights, "query_id").select("query_id", "term", "block", "idf", "avgdl")
        met = self._of(self.blocks, weights).join(need, ["term", "block"])
        return met.select("query_id", "term", "idf", "avgdl", *[c for c in met.columns if c == "part"], F.inline(F.arrays_zip("ids", "tfs", "dls"))).withColumnsRenamed({"ids": "id", "tfs": "tf", "dls": "dl"})

    def _scored(self, weights: DataFrame, wanted: DataFrame, k: int | None = None) -> DataFrame:
        """(query_id, id, bm25) of the texts of the wanted stretches; with ``k`` perhaps only those that may be among the k best."""
        if self.live is BlockIndex.live and weights.schema["query_id"].dataType == LongType():
            size, m = weights.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0)), F.count_distinct("query_id")).first()
            if size <= ASKED_BYTES and m <= MOST_QUERIES:
                return self._scored_by_stretch(weights.where("query_id IS NOT NULL"), wanted, k)
        part = part_score(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"))
        return self.live(self.postings_of(weights, wanted)).groupBy("query_id", "id").agg(F.sum(part).alias("bm25"))

    def _scored_by_stretch(self, weights: DataFrame, wanted: DataFrame, k: int | None) -> DataFrame:
        """``_scored`` where the weights, whose size was checked, go to every task: a stretch's blocks and the queries that want
        it meet in one task, and its scores are added up there. What is shuffled are blocks, however many queries want them."""
        shared = weights.sparkSession.sparkContext.broadcast(weights.select("query_id", "term", "idf", "avgdl").orderBy("term", "query_id").toArrow().combine_chunks())

        def run(batches):
            asked = shared.value
            if not asked.num_rows:
                return
            names = asked.column("term").combine_chunks().dictionary_encode()
            queries, q_of = np.unique(asked.column("query_id").to_numpy(), return_inverse=True)
            many = np.bincount(names.indices.to_numpy())
            first, names, m = np.cumsum(many) - many, names.dictionary, len(queries)
            idf, avgdl = asked.column("idf").to_numpy()[first], asked.column("avgdl")[0].as_py()
            best = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))

            def scored(rows: pa.Table):
                rows = rows.combine_chunks().to_batches()[0]
                heads, size = rows.column(1).is_null().to_numpy(zero_copy_only=False), pc.list_value_length(rows.column(2)).to_numpy()
                if heads.all() or not heads.any():
                    return best[0][:0], best[1][:0], best[2][:0]
                n = int(size[heads].sum())
                own, flat = np.zeros(m, bool), rows.column(2).flatten().to_numpy()
                own[np.searchsorted(queries, flat[:n])] = True
                term = pc.index_in(rows.column(1), value_set=names).drop_null().to_numpy()
                t, ids = np.repeat(term, size[~heads]), flat[n:]
                tf, dl = rows.column(3).flatten().to_numpy(), rows.column(4).flatten().to_numpy()
                score = idf[t] * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / avgdl))
                texts, row = np.unique(ids, return_inverse=True)
                times = many[t]
                q = q_of[np.repeat(first[t] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
                sums = np.bincount(np.repeat(row * m, times) + q, np.repeat(score, times), len(texts) * m).reshape(-1, m)
                sums[:, ~own] = 0
                text, query = np.nonzero(sums)
                return queries[query], texts[text], sums[text, query]

            def out(found):
                return pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["query_id", "id", "bm25"])

            held, block = [], None
            for batch in batches:
                at = batch.column(0).to_numpy()
                cuts = [0, *(np.nonzero(at[1:] != at[:-1])[0] + 1), len(at)]
                for a, z in zip(cuts, cuts[1:]):
                    if a == z:
                        continue
                    if held and at[a] != block:
                        found, held = scored(pa.Table.from_batches(held)), []
                        if k is None:
                            yield out(found)
                        else:
                            best = tuple(np.concatenate(x) for x in zip(best, found))
                            keep = best_rows(*best, k)
                            best = tuple(x[keep] for x in best)
                    block = at[a]
                    held.append(batch.slice(a, z - a))
            if held:
                found = scored(pa.Table.from_batches(held))
                best = found if k is None else tuple(np.concatenate(x) for x in zip(best, found))
            yield out(best)

        # The queries that want a stretch come before its blocks, as a row without a term.
        who = wanted.groupBy("block").agg(F.collect_list("query_id").alias("ids")).select("block", F.lit(None).cast("string").alias("term"), "ids", F.array().cast("array<bigint>").alias("tfs"), F.array().cast("array<int>").alias("dls"))
        terms = F.broadcast(weights.select("term").distinct())
        blocks = self._of(self.blocks.select("block", "term", "ids", "tfs", "dls"), weights).join(terms, "term", "left_semi").select("block", "term", "ids", "tfs", "dls")
        met = who.unionByName(blocks).repartition("block").sortWithinPartitions("block", F.asc_nulls_first("term"))
        return map_texts(met, run, "query_id long, id long, bm25 double")

    def stretches(self, weights: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(scores of the first stretches, these, the others that have to be scored), the first staged.

        First come the ``FIRST`` stretches of each query with the highest bounds. The k-th best score among their texts is one
        that the k-th best of all reaches too, and a stretch that is bound below it has none of the k best.
        """
        bounds = stage(self.heads(weights), "bounds")
        placed = top_k(bounds.withColumnRenamed("block", "id"), "bound", FIRST).select("query_id", F.col("id").alias("block"))
        first = stage(placed, "first")
        scored = stage(self._scored(weights, first, k), "scored")
        least = top_k(scored, "bm25", k).where(F.col("rank") == k).select("query_id", F.col("bm25").alias("least"))
        rest = bounds.join(first, ["query_id", "block"], "left_anti").join(least, "query_id", "left").where("least IS NULL OR bound >= least - 1e-9")
        return scored, first, rest.select("query_id", "block")

    def best(self, queries: DataFrame, key: str, text: str = "text", k: int = 10) -> tuple[DataFrame, DataFrame]:
        """As ``LexicalIndex.best``: the k best texts of each query, and the weights of the queries' terms."""
        weights = self.weights(queries, key, text)
        scored, _, rest = self.stretches(weights, k)
        return top_k(scored.unionByName(self._scored(weights, stage(rest, "rest"), k)), "bm25", k), weights

    def search(self, queries: DataFrame, key: str, text: str = "text", k: int = 10) -> DataFrame:
        """(query_id, rank, id, bm25): the k best that score above 0, the same rows as ``LexicalIndex.search`` has."""
        return self.best(queries, key, text, k)[0]
