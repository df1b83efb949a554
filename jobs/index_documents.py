"""Chunks of documents that keep arriving, ready to be indexed.

    python jobs/index_documents.py --documents PATH --output PATH --checkpoint PATH [--config FILE]

documents: a folder of Parquet files (or one file) to which files are added; Spark's file stream takes those that no run
has taken. Every document is registered with a status: 200 if it is accepted, 409 if its text was accepted before (of
equal texts that come together the one with the smallest key is), 422 if it has no text or no key. Accepted ones are cut into
overlapping windows of words. Under output:

    documents/batch=N/                 a row for each document that came with batch N
    chunks/batch=N/<partition_by>=V/   its chunks, with the number of their index terms

A run ends when it has taken all that is there. A batch that didn't end is taken again under its own number, and both its
tables replace what it had written; a run without anything new changes nothing. The key and the text tell documents apart:
rows that repeat both count once (the columns to keep have to be of kinds that can be ordered), and a key may come again with another text. Null and empty values of the partitioning
column are written as 'none'.
"""

from __future__ import annotations

import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import defaults, kept, main, settings_kept
from millrace.functions.staging import stage, unstage
from millrace.functions.text import terms
from millrace.operators.chunking import chunk_documents

JOB = "index_documents"
log = logging.getLogger(f"jobs.{JOB}")


def _kinds(spark: SparkSession, documents: str, c: dict) -> dict[str, str]:
    """The types of the columns that the job takes."""
    kinds = dict(spark.read.parquet(documents).dtypes)
    return {n: kinds[n] for n in [c["key"], c["text"], c["partition_by"], *c["keep"]]}


def _watched(spark: SparkSession, documents: str) -> str:
    """What the file stream watches: a folder as it is; a single file as a pattern of its name, as streams take no file."""
    try:
        spark.read.option("basePath", documents).parquet(documents)
    except IllegalArgumentException:
        folder, _, name = documents.rpartition("/")
        return f"{folder}/{{{name}}}"
    return documents


def _schemas(kinds: dict[str, str], c: dict) -> tuple[str, str]:
    """Of documents and of chunks, as they are read back."""
    key, part, own = f"`{c['key']}` {kinds[c['key']]}", f"`{c['partition_by']}` string", [f"`{n}` {kinds[n]}" for n in c["keep"]]
    return (
        ", ".join([key, "sha256 string, status int, n_chunks int", part, *own, "batch long"]),
        ", ".join([key, "sha256 string, seq int, start_word int, end_word int, n_terms int, text string", *own, "batch long", part]),
    )


def _take(docs: DataFrame, batch: int, output: str, kinds: dict[str, str], c: dict) -> int:
    """Register the documents of a batch and cut those that are accepted; the number of its rows."""
    spark, key, part = docs.sparkSession, c["key"], c["partition_by"]
    of_documents, of_chunks = _schemas(kinds, c)
    named = docs.select(key, F.col(c["text"]).alias("text"), F.coalesce(F.nullif(F.col(part).cast("string"), F.lit("")), F.lit("none")).alias(part), *c["keep"])
    named = named.withColumn("sha256", F.sha2("text", 256))
    # Statuses are decided over keys and digests; texts aren't moved for it. Of repeated rows the least others stand for all.
    rest = F.min(F.struct(part, *c["keep"])).alias("rest")
    came = named.groupBy(key, "sha256").agg(rest, F.max((F.coalesce(F.length("text"), F.lit(0)) > 0) & F.col(key).isNotNull()).alias("some"), F.count("*").alias("n_rows"))
    known = kept(spark, f"{output}/documents", of_documents).where((F.col("status") == 200) & (F.col("batch") != batch)).select("sha256").distinct()
    first = came.where("some").groupBy("sha256").agg(F.min(key).alias("first")).join(known, "sha256", "left_anti")
    status = F.when(~F.col("some"), 422).when(F.col("first") == F.col(key), 200).otherwise(409)
    came = stage(came.join(first, "sha256", "left").select(key, "sha256", status.alias("status"), "rest.*", "n_rows"), "came")
    texts = named.select(key, "sha256", "text").join(came.where("status = 200"), [key, "sha256"]).dropDuplicates([key, "sha256"])
    # A document's columns travel with its chunks as one.
    whole = F.struct(key, "sha256", part, *c["keep"]).alias("d")
    cut = chunk_documents(texts.select(whole, "text"), "d", "text", c["chunk_words"], c["chunk_overlap"])
    chunks = cut.select("d.*", "seq", "start_word", "end_word", F.size(terms(F.col("text"))).alias("n_terms"), "text", F.lit(batch).cast("long").alias("batch"))
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", part).parquet(f"{output}/chunks")
    counts = kept(spark, f"{output}/chunks", of_chunks).where(F.col("batch") == batch).groupBy(key, "sha256").agg(F.count("*").cast("int").alias("n_chunks"))
    # The register comes last: a batch is whole once its documents are in it.
    rows = came.drop("n_rows").join(counts, [key, "sha256"], "left").withColumn("n_chunks", F.when(F.col("status") == 200, F.coalesce("n_chunks", F.lit(0)))).withColumn("batch", F.lit(batch).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/documents")
    read = came.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    unstage(came)
    wrote = kept(spark, f"{output}/documents", of_documents).where(F.col("batch") == batch).groupBy("status").agg(F.count("*").alias("n"), F.sum("n_chunks").alias("chunks")).orderBy("status").collect()
    log.info("batch %d: %d rows read, documents by status %s, %d chunks written", batch, read, {r["status"]: r["n"] for r in wrote}, sum(r["chunks"] or 0 for r in wrote))
    return read


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict | None = None) -> None:
    """Take all documents that no earlier run with this checkpoint has taken, and end."""
    c = defaults(JOB) | (config or {})
    kinds = _kinds(spark, documents, c)
    stream = spark.readStream.schema(", ".join(f"`{n}` {k}" for n, k in kinds.items()))
    if c["files_per_batch"]:
        stream = stream.option("maxFilesPerTrigger", c["files_per_batch"])
    log.info("reading %s, writing %s", documents, output)
    rows: list[int] = []
    with settings_kept(spark):
        taken = stream.parquet(_watched(spark, documents)).writeStream.foreachBatch(lambda docs, batch: rows.append(_take(docs, batch, output, kinds, c)))
        query = taken.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
    log.info("took %d rows in %d batches; %d documents are registered", sum(rows), len(rows), kept(spark, f"{output}/documents", _schemas(kinds, c)[0]).count())


def result(spark: SparkSession, documents: str, output: str, config: dict | None = None) -> DataFrame:
    """What runs have written: every document with its status, accepted ones with a row for each chunk."""
    c = defaults(JOB) | (config or {})
    of_documents, of_chunks = _schemas(_kinds(spark, documents, c), c)
    on = [c["key"], "sha256", "batch"]
    chunks = kept(spark, f"{output}/chunks", of_chunks).drop(c["partition_by"], *c["keep"])
    return kept(spark, f"{output}/documents", of_documents).join(chunks, on, "left")


if __name__ == "__main__":
    main(JOB, __doc__, {"documents": "Parquet files that documents arrive in", "output": "folder of the output", "checkpoint": "folder of the stream's checkpoint"}, run)
