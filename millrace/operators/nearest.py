"""Exact cosine search over kept vectors: blocks of neighbours, with a centre and a radius, are passed over where they can't matter.

Vectors are laid beside the pivot that is nearest to each, and cut into blocks. The angle between a query and a vector
is at least that between the query and the block's centre, less the block's radius, so a block of which even that is
wider than the angle of the k-th best vector found so far has none of the k best. How much is passed over depends on how the
vectors lie; the rows don't.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.params import EPS
from millrace.functions.staging import stage
from millrace.functions.tables import map_texts
from millrace.operators.dense import QUERY_BLOCK, _best
from millrace.operators.ranking import DIGITS, top_k

#: Vectors of a block at most; pivots at most, which go to every task (a bounded sample); blocks that a query meets first.
ROWS, MOST_PIVOTS, FIRST = 1024, 2048, 4
#: Angles are computed to about 1e-8; a block is passed over only if it is out by more than this.
SLACK = 1e-6
BLOCKS, HEADS = "block long, ids binary, data binary, n int", "block long, centre binary, radius double"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1)), EPS)[:, None]


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _matrix(rows: pa.Array, n: int) -> np.ndarray:
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _laid(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(pivot, id, unit): the number of the nearest pivot of each unit vector; -1 for one of zeros or of no direction."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _unit(_matrix(part.column(1), part.num_rows))
                length = (x * x).sum(axis=1)
                near = np.where(np.abs(length - 1) < 1e-6, np.argmax(x @ pivots.T, axis=1) if len(pivots) else 0, -1)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["pivot", "id", "unit"])

    return map_texts(vectors.select(F.col("id").cast("long").alias("id"), "embedding"), run, "pivot int, id long, unit binary")


def _blocks(laid: DataFrame, rows: int) -> DataFrame:
    """(pivot, ids, data, n, centre, radius): up to ``rows`` vectors of one pivot. A pivot of very many vectors lies in many partitions."""

    def out(pivot, ids, units):
        x = np.frombuffer(b"".join(units)).reshape(len(ids), -1)
        centre = _unit(x.mean(axis=0)[None, :])[0]
        # Vectors without a direction, and ones that cancel out, are never passed over.
        radius = float(_angles(x @ centre).max()) if pivot >= 0 and abs(centre @ centre - 1) < 1e-6 else np.pi
        return pa.RecordBatch.from_pydict({"pivot": pa.array([pivot], pa.int32()), "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "data": pa.array([x.tobytes()], pa.binary()), "n": pa.array([len(ids)], pa.int32()), "centre": pa.array([centre.tobytes()], pa.binary()), "radius": [radius]})

    def run(batches):
        last, ids, units = None, [], []
        for batch in batches:
            for pivot, id_, unit in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (pivot != last or len(ids) == rows):
                    yield out(last, ids, units)
                    ids, units = [], []
                last = pivot
                ids.append(id_)
                units.append(unit)
        if ids:
            yield out(last, ids, units)

    sorted_ = laid.repartitionByRange("pivot", "id").sortWithinPartitions("pivot", "id")
    return map_texts(sorted_, run, "pivot int, ids binary, data binary, n int, centre binary, radius double")


@dataclass(frozen=True)
class NearestIndex:
    """blocks (BLOCKS) and heads (HEADS): the vectors, and where each block lies."""

    blocks: DataFrame
    heads: DataFrame

    @staticmethod
    def write(vectors: DataFrame, path: str, rows: int = ROWS) -> None:
        """Write an index of vectors (id: long, embedding, all of one length). Pivots are vectors chosen by a hash of their id:
        a sample of bounded size, which only says how the others are laid out; every vector is in the index."""
        n = vectors.count()
        chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(min(MOST_PIVOTS, -(-n // rows))).select("embedding").toArrow()
        pivots = _unit(_matrix(chosen["embedding"].combine_chunks(), chosen.num_rows)) if chosen.num_rows else np.zeros((0, 0))
        made = stage(_blocks(_laid(vectors, pivots), rows).withColumn("block", F.monotonically_increasing_id()), "blocks")
        made.select("block", "ids", "data", "n").write.parquet(f"{path}/blocks")
        made.select("block", "centre", "radius").write.parquet(f"{path}/heads")

    @staticmethod
    def open(spark: SparkSession, path: str) -> NearestIndex:
        return NearestIndex(spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), spark.read.schema(HEADS).parquet(f"{path}/heads"))

    def _bounds(self, asked: DataFrame, first: int | None) -> DataFrame:
        """(query_id, block, bound): the highest cosine that a block may have for a query (query_id, embedding, least). With
        ``first``: of that many blocks with the highest; else of those with ``least`` or more. Blocks of heads meet blocks of queries;
        only what is kept of a product leaves the task."""

        def pack(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    p = batch.slice(at, ROWS)
                    yield pa.RecordBatch.from_pydict({"blocks": pa.array([p.column(0).to_numpy().tobytes()], pa.binary()), "centres": pa.array([b"".join(p.column(1).to_pylist())], pa.binary()), "radii": pa.array([p.column(2).to_numpy().tobytes()], pa.binary())})

        def pack_queries(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, QUERY_BLOCK):
                    p = batch.slice(at, QUERY_BLOCK)
                    yield pa.RecordBatch.from_pydict({"asked": pa.array([p.column(0).to_numpy().tobytes()], pa.binary()), "units": pa.array([_unit(_matrix(p.column(1), p.num_rows)).tobytes()], pa.binary()), "least": pa.array([p.column(2).to_numpy().tobytes()], pa.binary())})

        def run(batches):
            for batch in batches:
                for blocks, centres, radii, ids, units, least in zip(*(c.to_pylist() for c in batch.columns)):
                    block, radius, own, floor = np.frombuffer(blocks, np.int64), np.frombuffer(radii), np.frombuffer(ids, np.int64), np.frombuffer(least)
                    q = np.frombuffer(units).reshape(len(own), -1)
                    bound = np.cos(np.maximum(_angles(np.frombuffer(centres).reshape(len(block), -1) @ q.T) - radius[:, None], 0.0)) + SLACK
                    bound[radius >= np.pi, :] = 2.0
                    bound[:, np.abs((q * q).sum(axis=1) - 1) > 1e-6] = 2.0  # a query without a direction
                    keep = _best(bound, block, first) if first else np.nonzero(bound >= floor[None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(own[keep[1]]), pa.array(block[keep[0]]), pa.array(bound[keep])], names=["query_id", "block", "bound"])

        heads = stage(map_texts(self.heads.select("block", "centre", "radius"), pack, "blocks binary, centres binary, radii binary"), "heads")
        queries = stage(map_texts(asked.select(F.col("query_id").cast("long"), "embedding", F.col("least").cast("double")), pack_queries, "asked binary, units binary, least binary"), "queries")
        return map_texts(heads.crossJoin(queries), run, "query_id long, block long, bound double")

    def _within(self, pairs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, id, cosine): of each query's blocks (query_id, block) the k best of each. The queries of a block that many
        ask for are dealt into pieces, which meet it one by one."""
        sizes = pairs.groupBy("block").agg(F.count("*").alias("m"))
        piece = F.expr(f"pmod(xxhash64(query_id), ceil(m / {QUERY_BLOCK}))").alias("piece")
        dealt = pairs.join(sizes, "block").select("query_id", "block", piece).join(asked.select("query_id", "embedding"), "query_id")
        packed = dealt.groupBy("block", "piece").agg(F.collect_list(F.struct("query_id", "embedding")).alias("q"))

        def run(batches):
            for batch in batches:
                for ids, data, n, q in zip(*(batch.column(i) for i in range(4))):
                    rows = q.values
                    own, asked_ids = np.frombuffer(ids.as_py(), np.int64), rows.field("query_id").to_numpy()
                    s = np.frombuffer(data.as_py()).reshape(n.as_py(), -1) @ _unit(_matrix(rows.field("embedding"), len(rows))).T
                    keep = _best(np.round(s, DIGITS), own, k)
                    yield pa.RecordBatch.from_arrays([pa.array(asked_ids[keep[1]]), pa.array(own[keep[0]]), pa.array(s[keep])], names=["query_id", "id", "cosine"])

        met = self.blocks.join(packed, "block").select("ids", "data", "n", "q")
        return map_texts(met, run, "query_id long, id long, cosine double")

    def pairs(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(what the first blocks have, these as (query_id, block), the others that have to be looked into), the first staged."""
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        first = stage(top_k(self._bounds(asked.withColumn("least", F.lit(0.0)), FIRST).withColumnRenamed("block", "id"), "bound", FIRST).select("query_id", F.col("id").alias("block")), "first")
        found = stage(top_k(self._within(first, asked, k), "cosine", k), "found")
        least = found.where(F.col("rank") == k).select("query_id", F.round("cosine", DIGITS).alias("least"))
        rest = self._bounds(asked.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0))), None)
        return found.drop("rank"), first, rest.select("query_id", "block").join(first, ["query_id", "block"], "left_anti")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, id, cosine): the k nearest vectors of each query (query_id, embedding), the same rows as ``dense.search``."""
        if k <= 0:
            return queries.select(F.col("query_id").cast("long"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("cosine")).where("false")
        found, _, rest = self.pairs(queries, k)
        return top_k(found.unionByName(self._within(stage(rest, "rest"), queries, k)), "cosine", k).select("query_id", "rank", "id", "cosine")
