"""Connected components of an edge table, by alternating stars over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stage, unstage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns), root the smallest node it can reach.

    Each round first hangs every node's larger neighbours under its smallest neighbour, then every node and
    its smaller neighbours under the smallest; the rounds end when every edge leads to a root. Their number
    grows with the logarithm of the longest path. Minima are aggregated before the shuffle and joined back,
    so that a node with very many neighbours is split by Spark's skew join and never lies in one task.
    Every round is written to the shared folder; nothing of the graph goes to the driver but two counts.
    Loops and repeated edges change nothing; an empty table gives an empty one.
    """
    now = stage(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.distinct(), "large")
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = large.join(low, F.col("a") == F.col("u"))
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        after = stage(small.distinct(), "small")
        unstage(now, large)
        now = after
        # A forest of stars: every node has one parent, and no parent has one.
        n, nodes = now.agg(F.count("*"), F.count_distinct("a")).first()
        if n == nodes and now.select("b").distinct().join(now.select(F.col("a").alias("x")), F.col("b") == F.col("x"), "left_semi").isEmpty():
            break
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return out.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
