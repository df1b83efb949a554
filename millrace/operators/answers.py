"""Extractive answers with citations, and the checks of a model's answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.params import NOT_FOUND
from millrace.functions.text import SPACE, strip, terms, words

#: Passages looked at, sentences in an answer, and characters of a sentence and of a passage that are shown.
LOOKED_AT, MOST_LINES, LINE_CHARS, PASSAGE_CHARS = 5, 3, 400, 300


def best_sentences(pairs: DataFrame) -> DataFrame:
    """``pairs`` (question, passage and keys) with score and sentence: of the sentences of four words or more
    the one with the most distinct terms of the question, long ones counting less; the first of equals. A
    passage without one has 0 and its first PASSAGE_CHARS characters."""
    keys = [c for c in pairs.columns if c not in ("question", "passage")]
    asked = F.array_distinct(terms(F.col("question")))
    parts = F.filter(F.split("passage", rf"(?<=[.!?;]){SPACE}"), lambda s: F.size(words(s)) >= 4)
    scored = F.transform(parts, lambda s: F.struct(
        (F.size(F.array_intersect(F.array_distinct(terms(strip(s))), asked)) / (1 + F.char_length(strip(s)) / 400)).alias("score"), strip(s).alias("sentence")))
    best = F.aggregate(scored, F.struct(F.lit(-1.0).alias("score"), F.lit("").alias("sentence")), lambda a, s: F.when(s["score"] > a["score"], s).otherwise(a))
    picked = pairs.withColumn("mr_b", best)
    none = F.col("mr_b.score") < 0
    return picked.select(
        *keys, "question", "passage", F.when(none, 0.0).otherwise(F.col("mr_b.score")).alias("score"),
        F.when(none, F.substring(strip(F.col("passage")), 1, PASSAGE_CHARS)).otherwise(F.col("mr_b.sentence")).alias("sentence"),
    )


def extractive(pairs: DataFrame, reason: str = "") -> DataFrame:
    """(query_id, answer, mode, reason, citations) from pairs (query_id, rank, question, passage).

    The best sentences of the first LOOKED_AT passages that share a term with the question, MOST_LINES at
    most, each with its passage's number.
    """
    s = best_sentences(pairs.where(F.col("rank") <= LOOKED_AT)).where("score > 0")
    s = s.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("n") <= MOST_LINES)
    line = F.concat(F.lit("- "), F.substring("sentence", 1, LINE_CHARS), F.lit(" ["), F.col("rank").cast("string"), F.lit("]"))
    made = s.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    out = pairs.select("query_id").distinct().join(made, "query_id", "left")
    return out.select(
        "query_id", F.coalesce(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit(NOT_FOUND)).alias("answer"),
        F.lit("extractive").alias("mode"), F.lit(reason).alias("reason"),
        F.coalesce(F.transform("l", lambda x: x["rank"].cast("int")), F.array().cast("array<int>")).alias("citations"),
    )


def citations(answer: Column, n_passages: Column) -> tuple[Column, Column]:
    """(valid, invalid): the distinct numbers cited as [n], sorted, inside and outside 1 to n_passages."""
    cited = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: F.try_to_number(x, F.lit("9999999999")).cast("long"))))
    cited = F.filter(cited, lambda x: x.isNotNull())
    return F.filter(cited, lambda x: (x >= 1) & (x <= n_passages)), F.filter(cited, lambda x: (x < 1) | (x > n_passages))


def prompts(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """(query_id, prompt): the numbered passages and the question, for a model. ``most``: passages of a rank up to that;
    a caller who asks for the passages of a search has no more than it returns."""
    pairs = pairs if most is None else pairs.where(F.col("rank") <= most)
    item = F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("passage")).alias("t"))
    g = pairs.groupBy("query_id", "question").agg(F.array_sort(F.collect_list(item)).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["t"]), "\n\n")
    return g.select("query_id", F.concat(F.lit("<passages>\n"), text, F.lit("\n</passages>\n\nQuestion: "), F.col("question")).alias("prompt"))


def settle(answers: DataFrame, extracts: DataFrame) -> DataFrame:
    """A model's answers where they hold, else the extract and why.

    answers: query_id, n_passages, status (HTTP, null if none came), answer, model, and optionally finish, the model's
    own word for why it ended: anything but null and 'stop' is a refusal. Nothing is called here: the answers
    come from whatever function the caller maps over ``prompts``.
    """
    refused = ~F.lower("a.finish").isin("stop", "") if "finish" in answers.columns else F.lit(False)
    valid, invalid = citations(F.col("a.answer"), F.col("a.n_passages"))
    why = (
        F.when(F.coalesce("a.n_passages", F.lit(0)) == 0, "no passages retrieved")
        .when(F.col("a.status").isNull(), "model not reached")
        .when(F.col("a.status").isin(401, 403), "model key refused")
        .when(F.col("a.status") == 429, "model rate limit")
        .when(F.col("a.status") >= 400, F.concat(F.lit("model error "), F.col("a.status").cast("string")))
        .when(F.coalesce(refused, F.lit(False)), "model declined")
        .when(F.coalesce(F.trim("a.answer"), F.lit("")) == "", "model answer empty")
        .when((F.size(invalid) > 0) | ((F.col("a.answer") != NOT_FOUND) & (F.size(valid) == 0)), "answer failed citation check")
    )
    joined = answers.alias("a").join(extracts.alias("e"), F.expr("a.query_id = e.query_id"), "left").withColumn("why", why)
    ok = F.col("why").isNull()
    return joined.select(
        F.col("a.query_id").alias("query_id"), F.when(ok, F.col("a.answer")).otherwise(F.coalesce("e.answer", F.lit(NOT_FOUND))).alias("answer"),
        F.when(ok, "model").otherwise("extractive").alias("mode"), F.when(ok, "").otherwise(F.col("why")).alias("reason"),
        F.when(ok, valid.cast("array<int>")).otherwise(F.coalesce("e.citations", F.array().cast("array<int>"))).alias("citations"),
        F.when(ok, F.col("a.model")).alias("model"),
    )
