"""Mixing sources to target weights by Poisson replication (operator 10).

The distribution of each source's copies is tabled once, and every document looks its own hash up in its source's
table: the least k whose cumulative chance is above it.
"""

from __future__ import annotations

from math import ceil, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import hash60, partitions, shielded, stage, table

#: Bytes that a partition of the shuffled output should hold at most.
PART_BYTES = 128 << 20
#: Tables of all sources together that go to every task; beyond, rows of a source are dealt into SALTS joins.
BROADCAST_BYTES, SALTS = 64 << 20, 64
#: Copies of a document that one task makes.
COPIES = 256


def poisson_table(rate: float) -> tuple[int, np.ndarray]:
    """(least, cdf): P(X <= least + i) for X ~ Poisson(rate), from 40 deviations below the rate, where a double has no
    smaller chance, to 12 above it, beyond which less than 2^-53 is left: about 52 sqrt(rate) values. Chances are made in
    logarithms, so that a large rate doesn't underflow."""
    least, most = max(0, int(rate - 40 * sqrt(rate))), ceil(rate + 12 * sqrt(rate) + 30)
    k = np.arange(least + 1, most + 1)
    logs = np.concatenate([[least * log(rate) - rate - lgamma(least + 1)], np.log(rate / k)]).cumsum()
    cdf = np.exp(logs).cumsum()
    return least, cdf / cdf[-1]


def with_tables(rates: DataFrame) -> DataFrame:
    """``rates`` (rate above 0, and more columns) with mr_least and mr_cdf."""
    at = rates.columns.index("rate")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                least, cdf = poisson_table(row.column(at)[0].as_py())
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([least], pa.int64()), pa.array([cdf], pa.list_(pa.float64()))], names=[*row.schema.names, "mr_least", "mr_cdf"])

    return rates.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rates.schema.fields) + ", mr_least bigint, mr_cdf array<double>")


def poisson_count(u: Column, least: str = "mr_least", cdf: str = "mr_cdf") -> Column:
    """The least k with u < P(X <= k); u in [0, 1). A search by halves in the table."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(cdf) + 1)).cast("int"))
    span = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("lo"), F.size(cdf).alias("hi"), u.alias("u")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(F.when(
            F.get(cdf, F.floor((s["lo"] + s["hi"]) / 2).cast("int")) <= s["u"], F.struct((F.floor((s["lo"] + s["hi"]) / 2) + 1).cast("int").alias("lo"), s["hi"].alias("hi"), s["u"].alias("u"))
        ).otherwise(F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi"), s["u"].alias("u")))),
    )
    return F.col(least) + span["lo"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None) -> DataFrame:
    """(source, n_bytes, mean repetition rate) of each source.

    weights: target share of each source in the bytes of the mixture, null under the key None, in any
    scale; a source without one gets none. Without weights every source gets the same. budget: bytes of
    the mixture, by default those of the input. A source without bytes has rate 0.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("n_bytes"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        sizes = sizes.alias("s").join(given.alias("w"), F.expr("s.source <=> w.source"), "left").selectExpr("s.source", "n_bytes", "coalesce(weight, 0D) AS weight")
    sizes = stage(sizes, "op10-sizes")
    t = sizes.agg(F.sum("n_bytes"), F.sum(F.when(F.col("n_bytes") > 0, F.col("weight")))).first()
    budget, weight = float(budget if budget is not None else t[0] or 0), float(t[1] or 0) or 1.0
    return sizes.select("source", "n_bytes", F.when(F.col("n_bytes") > 0, F.col("weight") / weight * budget / F.col("n_bytes")).otherwise(0.0).alias("rate"))


@shielded("copy_no", "n_copies", "shuffle_key")
def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, seed: int = 42) -> DataFrame:
    """Repeat each document a Poisson-distributed number of times, so that sources reach their target
    weights on average, and put the copies into a global random order.

    docs: doc_id, text, source and any more columns. Adds copy_no (from 0), n_copies and shuffle_key (the
    order; ties by doc_id and copy_no); input columns of these names are replaced. Partitions follow each
    other in the order of the key. The number of copies depends on seed, doc_id and the source's rate only:
    repeated rows get the same. A null doc_id counts as an id of its own; a null source is a source; a null
    text has no bytes. An empty table gives an empty one.

    Tables of up to BROADCAST_BYTES in all go to every task; larger ones meet documents by source and a hash of the id, so
    that no source lies in one task. A document of very many copies is dealt out to other tasks, COPIES at a time, before they are made.
    """
    spark = docs.sparkSession
    rates = source_rates(docs, weights, budget).where("rate > 0").select(F.col("source").alias("mr_source"), "n_bytes", "rate")
    tabled = stage(with_tables(rates), "op10-rates")
    facts = tabled.agg(F.sum(F.col("n_bytes") * F.col("rate")), F.max(F.col("mr_least") + F.size("mr_cdf")), F.sum(8 * F.size("mr_cdf") + 64)).first()
    n = max(partitions(spark), int((facts[0] or 0) // PART_BYTES) + 1)
    u = hash60(str(seed), "copies", F.col("doc_id")) / float(1 << 60)
    tables = tabled.select("mr_source", "mr_least", "mr_cdf")
    if (facts[2] or 0) <= BROADCAST_BYTES:
        met = docs.join(F.broadcast(tables), F.expr("source <=> mr_source"))
    else:
        salted = docs.withColumn("mr_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        met = salted.join(tables.withColumn("mr_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), F.expr("source <=> mr_source AND mr_salt = mr_s")).drop("mr_salt", "mr_s")
    counted = met.withColumn("n_copies", poisson_count(u)).drop("mr_source", "mr_least", "mr_cdf")
    counted = counted.where("n_copies > 0")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1))
    if (facts[1] or 0) <= COPIES:
        copies = counted.withColumn("copy_no", every)
    else:
        parts = counted.where(f"n_copies > {COPIES}").withColumn("mr_part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_copies - 1) DIV {COPIES}"))))
        dealt = parts.repartition(n, "doc_id", "mr_part")
        some = F.explode(F.sequence(F.col("mr_part") * COPIES, F.least(F.col("n_copies"), (F.col("mr_part") + 1) * COPIES) - 1))
        copies = counted.where(f"n_copies <= {COPIES}").withColumn("copy_no", every).unionByName(dealt.withColumn("copy_no", some).drop("mr_part"))
    copies = copies.withColumns({"n_copies": F.col("n_copies").cast("int"), "copy_no": F.col("copy_no").cast("int")})
    copies = copies.withColumn("shuffle_key", hash60(str(seed), "order", F.col("doc_id"), F.col("copy_no")))
    # The key is uniform: equal slices of its range are equal partitions, and no sampling is needed.
    slice_ = (F.shiftright("shuffle_key", 30) * n).cast("long")
    return copies.repartitionById(n, F.shiftright(slice_, 30).cast("int")).sortWithinPartitions("shuffle_key", "doc_id", "copy_no")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source gets the same share of as many bytes as the table has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mix(docs)


QUERIES = {"op10_mixing": op10_mixing}

ORACLE = {
    "op10_mixing": """
WITH d AS (
    SELECT *, ('0x' || substr(md5('42:copies:' || doc_id), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS u FROM documents
), s AS (
    SELECT source, sum(strlen(text)) AS n FROM documents GROUP BY source
), r AS (
    SELECT source, 1.0::DOUBLE / count(*) OVER () * sum(n) OVER () / n AS rate FROM s
), p AS (
    SELECT source, rate, unnest(range(0, (rate + 12 * sqrt(rate) + 30)::BIGINT)) AS k FROM r
), f AS (
    SELECT source, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p
), n AS (
    SELECT doc_id, count(*) AS n FROM d JOIN f USING (source) WHERE cdf <= u GROUP BY doc_id
), c AS (
    SELECT d.*, n::INT AS n_copies, unnest(range(0, n))::INT AS copy_no FROM d JOIN n USING (doc_id)
)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy_no,
    ('0x' || substr(md5('42:order:' || doc_id || ':' || copy_no), 1, 15))::BIGINT AS shuffle_key
FROM c
"""
}
