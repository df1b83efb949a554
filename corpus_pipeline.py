"""A corpus made ready for training: five operators, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import WORD, settled, unstage
from millrace.llm.op1_bpe import encode
from millrace.llm.op2_simhash import near_dedup
from millrace.llm.op4_passages import drop_repeats
from millrace.llm.op6_quality import quality_filter
from millrace.llm.op10_mixing import mix

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules of their language and source go."""
    return quality_filter(_documents(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup(_documents(docs))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too are cut; a document of which nothing is left goes."""
    cut = drop_repeats(_documents(docs))
    return _documents(cut.where((cut["mr_removed"] == 0) | cut["text"].rlike(WORD)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same share of the bytes; copies are in a global random order."""
    return _documents(mix(_documents(docs)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of them and of what they decode to."""
    return encode(_documents(docs))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("mixing", mixing), ("tokens", tokens)]

#: Stages 2, 4 and 1 can't be said in SQL; tests hold run() against a version without Spark.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        before, docs = docs, settled(lambda f=function, d=docs: f(spark, d, sf_dir), f"pipeline-{name}")
        unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
