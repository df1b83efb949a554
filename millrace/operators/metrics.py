"""Relevance labels and ranking metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.staging import stage
from millrace.functions.tables import map_texts
from millrace.functions.text import words


#: Bytes of phrases in one automaton.
AUTOMATON_BYTES = 16 << 20


def _words_of(texts: DataFrame) -> DataFrame:
    """(id, word): the distinct words of each text (id, t), in Arrow batches."""

    def run(batches):
        for batch in batches:
            found = [list(set(t.split())) if t else [] for t in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), np.fromiter(map(len, found), np.int64, len(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([w for f in found for w in f], pa.string())], names=["id", "word"])

    return map_texts(texts, run, f"id {texts.schema['id'].dataType.simpleString()}, word string")


def containing(phrases: DataFrame, texts: DataFrame, most: int = AUTOMATON_BYTES) -> DataFrame:
    """(query_id, id, p): the texts (id, t) that contain a phrase (query_id, p, not empty), as it stands.

    Phrases of up to ``most`` bytes together make one automaton, by which a task passes over each text once. Of more,
    those of three words or more meet the texts on a word, and the others make several automata, one pass each.
    """
    asked = stage(phrases.where("length(p) > 0").select("query_id", "p"), "phrases")
    different = asked.select("p").distinct()
    size = different.agg(F.coalesce(F.sum(F.octet_length("p")), F.lit(0))).first()[0]
    if size <= most:
        return _by_automaton(asked, texts)
    short = asked.where(F.size(words(F.col("p"))) < 3)
    found = _by_inner_word(asked.where(F.size(words(F.col("p"))) >= 3), texts)
    total = short.select("p").distinct().agg(F.coalesce(F.sum(F.octet_length("p")), F.lit(0))).first()[0]
    slices = -(-total // most)
    for i in range(slices):
        found = found.unionByName(_by_automaton(short.where(F.pmod(F.xxhash64("p"), F.lit(slices)) == i), texts))
    return found


def _by_automaton(phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """``containing`` for phrases (query_id, p) of a size that was checked: they go to all tasks."""
    listed = sorted(r[0] for r in phrases.select("p").distinct().collect())
    shared = phrases.sparkSession.sparkContext.broadcast(listed)

    def run(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for n, p in enumerate(shared.value):
            machine.add_word(p, n)
        if not shared.value:
            return
        machine.make_automaton()
        for batch in batches:
            at, which = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                found = {n for _, n in machine.iter(t)} if t else ()
                at += [i] * len(found)
                which += [shared.value[n] for n in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(which, pa.string())], names=["id", "p"])

    held = map_texts(texts.select("id", "t"), run, f"id {texts.schema['id'].dataType.simpleString()}, p string")
    return held.join(F.broadcast(phrases), "p").select("query_id", "id", "p")


def _by_inner_word(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """``containing`` for any number of phrases (query_id, p) of three words or more. Whatever contains a phrase has the phrase's
    inner words as words of its own. So phrases and texts meet on one of these, the one that the fewest texts have, and
    are then compared."""
    asked = asked.select("query_id", "p", words(F.col("p")).alias("w"))
    inner = asked.select("query_id", "p", F.explode(F.array_distinct(F.slice("w", F.lit(2), F.size("w") - 2))).alias("word"))
    held = stage(_words_of(texts.select("id", "t")).join(inner.select("word").distinct(), "word", "left_semi"), "held")
    rare = inner.join(held.groupBy("word").agg(F.count("*").alias("n")), "word", "left")
    rare = rare.groupBy("query_id", "p").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "word"))["word"].alias("word"))
    return rare.join(held, "word").select("query_id", "p", "id").join(texts.select("id", "t"), "id").where(F.contains("t", "p")).select("query_id", "id", "p")


def build_qrels(phrases: DataFrame, texts: DataFrame, body: tuple[int, int] | None = None) -> DataFrame:
    """(query_id, id, grade) from phrases (query_id, phrase, grade) and texts (id, text): the best grade of the
    phrases that a text contains, without regard to case. ``body``: only ids from the first to before the last number."""
    p = phrases.select("query_id", "grade", F.lower("phrase").alias("p"))
    t = texts if body is None else texts.where(F.col("id").between(body[0], body[1] - 1))
    found = containing(p.select("query_id", "p").distinct(), t.select("id", F.lower("text").alias("t")))
    return found.join(p, ["query_id", "p"]).groupBy("query_id", "id").agg(F.max("grade").alias("grade"))


def require_labels(queries: DataFrame, qrels: DataFrame) -> None:
    """Raise if a query has no relevant text: its metrics would say nothing about a ranking."""
    bare = queries.select("query_id").join(qrels.where("grade > 0"), "query_id", "left_anti").orderBy("query_id").head(5)
    if bare:
        raise ValueError(f"queries without a relevant text: {', '.join(str(r[0]) for r in bare)}")


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def ideals(counts: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ideal): the gain of the best order of a query's labels up to rank k, from how many there are: counts
    (query_id, grade, n). No more than k rows of a grade are made."""
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "i")
    rows = counts.where("n > 0").select("query_id", "grade", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(k)).cast("long"))).alias("i"))
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("r"))).alias("ideal"))


def per_query(queries: DataFrame, ranking: DataFrame, qrels: DataFrame, k: int = 10, counts: DataFrame | None = None) -> DataFrame:
    """(query_id, first_rank, rr, dcg, ndcg) for every query: ranking (query_id, rank, id), qrels (query_id, id, grade).

    A query without a relevant hit up to rank k has null, 0, 0, 0; the ideal is made of all its labels. counts: (query_id,
    grade, n), how many labels there are, if they are known; qrels then need to have the ranking's only.
    """
    found = ranking.where(F.col("rank") <= k).join(qrels, ["query_id", "id"]).groupBy("query_id").agg(
        F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first_rank"), F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg")
    )
    counts = qrels.groupBy("query_id", "grade").agg(F.count("*").alias("n")) if counts is None else counts
    out = queries.select("query_id").join(found, "query_id", "left").join(ideals(counts, k), "query_id", "left")
    dcg = F.coalesce("dcg", F.lit(0.0))
    return out.select(
        "query_id", "first_rank", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("rr"), dcg.alias("dcg"),
        F.when(F.col("ideal") > 0, dcg / F.col("ideal")).otherwise(0.0).alias("ndcg"),
    )


def report(per_mode: DataFrame) -> DataFrame:
    """(mode, n_queries, n_missed, mrr, ndcg) from per_query rows with a mode; with median_ms if they have ms, the time
    that a caller took for a query."""
    timed = [F.percentile("ms", 0.5).alias("median_ms")] if "ms" in per_mode.columns else []
    return per_mode.groupBy("mode").agg(
        F.count("*").alias("n_queries"), F.count_if(F.col("first_rank").isNull()).alias("n_missed"),
        F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr"), F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg"), *timed,
    )
