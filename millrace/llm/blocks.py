"""Comparing the rows of a bucket in blocks of bounded size, whatever the size of the bucket."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import partitions, stage


def blocks(keys: DataFrame, payload: DataFrame | None, cap: int) -> DataFrame:
    """Rows of blocks in which every two ids that share a key meet.

    keys: key (long), id (long) and more columns, distinct. payload: id and more columns, one row for each id, or None. A key of one
    id has no block. Up to ``cap`` ids are one block; the ids of a larger bucket are dealt into chunks of
    about cap, and every two chunks are a block. A block is known by (key, mr_i, mr_j); mr_chunk is the
    row's own chunk, and only rows of different chunks need comparing where mr_i and mr_j differ. Blocks
    lie whole and together in a partition, so that they can be cut from the stream of its rows.
    """
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keys.join(sizes, "key").withColumn("mr_c", F.expr(f"CAST(ceil(n / {cap}) AS int)"))
    dealt = shared.withColumn("mr_chunk", F.expr("CAST(pmod(xxhash64(id), mr_c) AS int)"))
    met = dealt.select(*keys.columns, "mr_chunk", F.explode(F.expr("sequence(0, mr_c - 1)")).alias("mr_o"))
    met = met.select(*keys.columns, "mr_chunk", F.least("mr_chunk", "mr_o").alias("mr_i"), F.greatest("mr_chunk", "mr_o").alias("mr_j"))
    if payload is not None:
        met = stage(met, "met").join(payload, "id")
    return met.repartition(partitions(keys.sparkSession), "key", "mr_i", "mr_j").sortWithinPartitions("key", "mr_i", "mr_j")


def stream(batches, work: Callable[[dict], list[pa.RecordBatch]]):
    """Cut the sorted rows of ``blocks`` into blocks and call work with each as a dict of NumPy arrays or lists."""
    kept: pa.Table | None = None

    def cut(t: pa.Table, last: bool):
        cols = {c: t.column(c).to_numpy() if pa.types.is_integer(t.schema.field(c).type) else t.column(c) for c in t.schema.names}
        same = np.ones(max(0, t.num_rows - 1), bool)
        for c in ("key", "mr_i", "mr_j"):
            same &= cols[c][1:] == cols[c][:-1]
        edges = np.concatenate([[0], np.nonzero(~same)[0] + 1, [t.num_rows]])
        stop = len(edges) - 1 if last else len(edges) - 2
        for a, b in zip(edges[:stop].tolist(), edges[1 : stop + 1].tolist()):
            if b - a > 1:
                yield from work({c: v[a:b] for c, v in cols.items()})
        return t.slice(int(edges[stop]))

    for batch in batches:
        t = pa.Table.from_batches([batch])
        kept = t if kept is None else pa.concat_tables([kept, t]).combine_chunks()
        if kept.num_rows:
            kept = yield from cut(kept, False)
    if kept is not None and kept.num_rows:
        yield from cut(kept, True)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges among (a, b) that connect the same of n items as all of them: n - 1 at most."""
    parent, out = list(range(n)), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        u, v = find(x), find(y)
        if u != v:
            parent[max(u, v)] = min(u, v)
            out.append((x, y))
    return out
