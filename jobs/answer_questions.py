"""Answers to a table of questions from a table of documents, each with the passages that it cites.

    python jobs/answer_questions.py --documents PATH --questions PATH --output PATH [--config FILE]

All questions are asked at once of the chunks of all documents: by words (mode 'bm25'), or by words and vectors
('hybrid'). An answer is made of the best sentences of the best passages, with their numbers. Under output:

    answers/edition=E/answered=true|false/    a row for each question
    passages/edition=E/rank=R/                the passages that were looked at

A run replaces its own edition and leaves the others, so that it may be run again, and a nightly job names its editions by
day. Keys have to be long and distinct in both tables. A question without text or without any passage is answered by the
not-found sentence; documents without text have no chunks.
"""

from __future__ import annotations

import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import defaults, main, settings_kept
from millrace.functions.params import NOT_FOUND
from millrace.functions.staging import settled, unstage
from millrace.functions.tables import spread
from millrace.operators.answers import extractive
from millrace.operators.chunking import chunk_documents
from millrace.operators.lexical import LexicalIndex
from millrace.operators.search import Corpus

JOB = "answer_questions"
ANSWERS = "query_id long, question string, answer string, citations array<int>, n_passages int, answered boolean"
PASSAGES = "query_id long, chunk_id long, doc_id long, score double, text string, rank int"
log = logging.getLogger(f"jobs.{JOB}")


def _passages(docs: DataFrame, questions: DataFrame, mode: str, k: int) -> DataFrame:
    """(query_id, rank, chunk_id, doc_id, score, text): the k best chunks for each question."""
    cut = chunk_documents(docs, "doc_id", "text", numbered=True).select(F.col("chunk_id").alias("id"), F.col("doc_id").cast("string").alias("doc"), "page", "text")
    if mode == "hybrid":
        out = Corpus.build(cut).passages(questions, k).withColumn("score", F.col("rrf"))
    elif mode == "bm25":
        out = LexicalIndex.build(cut, "id").search(questions, "query_id", k=k).join(cut, "id").withColumnsRenamed({"id": "chunk_id", "bm25": "score"})
    else:
        raise ValueError(f"no such mode: {mode}")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "chunk_id", F.col("doc").cast("long").alias("doc_id"), "score", "text")


def run(spark: SparkSession, documents: str, questions: str, output: str, config: dict | None = None) -> None:
    """Answer all questions and write them as the edition that the configuration names."""
    c = defaults(JOB) | (config or {})
    docs = spread(spark.read.parquet(documents).select(F.col(c["document_key"]).cast("long").alias("doc_id"), F.col(c["document"]).alias("text")))
    asked = spark.read.parquet(questions).select(F.col(c["question_key"]).cast("long").alias("query_id"), F.col(c["question"]).alias("text"))
    log.info("read %d documents and %d questions", docs.count(), asked.count())
    with settings_kept(spark):
        found = settled(lambda: _passages(docs, asked, c["mode"], c["passages"]), "found")
        texts = asked.withColumnRenamed("text", "question")
        made = extractive(found.join(texts, "query_id").select("query_id", "rank", "question", F.col("text").alias("passage")))
        seen = found.groupBy("query_id").agg(F.count("*").cast("int").alias("n_passages"))
        answers = texts.join(made, "query_id", "left").join(seen, "query_id", "left").select(
            "query_id", "question", F.coalesce("answer", F.lit(NOT_FOUND)).alias("answer"), F.coalesce("citations", F.array().cast("array<int>")).alias("citations"),
            F.coalesce("n_passages", F.lit(0)).alias("n_passages"), (F.size(F.coalesce("citations", F.array().cast("array<int>"))) > 0).alias("answered"),
        )
        for name, rows, part in (("answers", answers, "answered"), ("passages", found, "rank")):
            at = f"{output}/{name}/edition={c['edition']}"
            rows.write.mode("overwrite").partitionBy(part).parquet(at)
            kind = ANSWERS if name == "answers" else PASSAGES
            log.info("wrote %d rows to %s", spark.read.schema(kind).parquet(at).count(), at)
        unstage(found)


def result(spark: SparkSession, output: str, config: dict | None = None) -> DataFrame:
    """An edition: each question with its answer and a row for each of its passages."""
    c = defaults(JOB) | (config or {})
    answers = spark.read.schema(ANSWERS).parquet(f"{output}/answers/edition={c['edition']}")
    return answers.join(spark.read.schema(PASSAGES).parquet(f"{output}/passages/edition={c['edition']}"), "query_id", "left")


if __name__ == "__main__":
    main(JOB, __doc__, {"documents": "Parquet table of documents", "questions": "Parquet table of questions", "output": "folder of the output"}, run)
