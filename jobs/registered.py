"""The jobs as registered queries: each runs its job twice over the given tables, in a folder of its own, and reads the output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import answer_questions, index_documents
from millrace.functions.staging import shared_dir
from millrace.plans import oracle as o


def _folder(spark: SparkSession, job: str) -> str:
    return f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, documents = _folder(spark, "job1"), f"{sf_dir}/documents.parquet"
    for _ in range(2):
        index_documents.run(spark, documents, f"{at}/output", f"{at}/checkpoint")
    out = index_documents.result(spark, documents, f"{at}/output")
    numbers = [F.col(n).cast("long").alias(n) for n in ("status", "n_chunks", "seq", "start_word", "end_word", "n_terms")]
    return out.select("doc_id", "sha256", "lang", "source", *numbers, "text")


def job2_answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "job2")
    for _ in range(2):
        answer_questions.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", at)
    out = answer_questions.result(spark, at)
    return out.select(
        "query_id", "question", "answer", F.array_join(F.col("citations").cast("array<string>"), ",").alias("citations"), F.col("n_passages").cast("long").alias("n_passages"),
        "answered", F.col("rank").cast("long").alias("rank"), "chunk_id", "doc_id", F.round("score", 6).alias("score"), F.md5("text").alias("text_md5"),
    )


QUERIES = {"job1_index_documents": job1_index_documents, "job2_answer_questions": job2_answer_questions}

ORACLE = {
    "job1_index_documents": f"""
WITH {o.CHUNKS}, d AS (
    SELECT doc_id, coalesce(nullif(lang, ''), 'none') AS lang, source, sha256(text) AS sha256,
        CASE WHEN doc_id IS NULL OR coalesce(text, '') = '' THEN 422 WHEN doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) THEN 200 ELSE 409 END::BIGINT AS status FROM documents
), n AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id)
SELECT d.doc_id, sha256, lang, source, status, CASE WHEN status = 200 THEN coalesce(n, 0) END::BIGINT AS n_chunks, seq::BIGINT AS seq, start_word::BIGINT AS start_word, end_word::BIGINT AS end_word,
    len({o.tokens('text')})::BIGINT AS n_terms, text
FROM d LEFT JOIN n ON n.doc_id = d.doc_id AND status = 200 LEFT JOIN chunks c ON c.doc_id = d.doc_id AND status = 200""",
    "job2_answer_questions": f"""
WITH {o.CHUNKS}, {o.LEXICAL}, {o.QUERIES}, {o.BM25}, {o.ranked('r', 'bm', 'bm25')}, hits AS MATERIALIZED (
    SELECT r.query_id, r.rank, r.id, doc_id, bm25, chunks.text AS passage, q.text AS question FROM r JOIN chunks ON r.id = chunks.id JOIN q ON q.query_id = r.query_id WHERE rank <= 5
), parts AS (
    SELECT query_id, rank, {o.tokens('question')} AS qt, list_filter(string_split(regexp_replace(passage, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: len(regexp_extract_all(s, '{o.WORD}')) >= 4) AS p FROM hits
), each AS (SELECT query_id, rank, qt, trim(unnest(p)) AS sentence, unnest(range(len(p))) AS pos FROM parts),
scored AS (SELECT *, len(list_intersect(list_distinct({o.tokens('sentence')}), list_distinct(qt))) / (1 + length(sentence) / 400) AS score FROM each),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, rank ORDER BY score DESC, pos) = 1),
cited AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM best WHERE score > 0),
made AS (SELECT query_id, string_agg('- ' || substr(sentence, 1, 400) || ' [' || rank || ']', chr(10) ORDER BY rank) AS answer, string_agg(rank::VARCHAR, ',' ORDER BY rank) AS citations FROM cited WHERE i <= 3 GROUP BY query_id),
seen AS (SELECT query_id, count(*) AS n FROM hits GROUP BY query_id)
SELECT q.query_id, q.text AS question, coalesce(answer, 'Not found in the document.') AS answer, coalesce(citations, '') AS citations, coalesce(n, 0)::BIGINT AS n_passages, answer IS NOT NULL AS answered,
    rank, id AS chunk_id, doc_id, round(bm25, 6) AS score, md5(passage) AS text_md5
FROM q LEFT JOIN made ON made.query_id = q.query_id LEFT JOIN seen ON seen.query_id = q.query_id LEFT JOIN hits ON hits.query_id = q.query_id""",
}
