"""Exact cosine search over dense and over hashed, sparse vectors."""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.params import DEPTH, EMBED_DIM, EPS
from millrace.functions.staging import stage
from millrace.functions.tables import hold, map_texts
from millrace.functions.text import SPACE
from millrace.operators.ranking import DIGITS, best_rows, top_k

#: Queries that are scored together, and rows of vectors scored at a time.
QUERY_BLOCK, ROW_BLOCK = 1024, 1024
#: Bytes of queries that are broadcast, buckets of words that a worker remembers, and rows that a task holds before it passes them on.
BROADCAST_BYTES, REMEMBERED, HELD_ROWS = 64 << 20, 100_000, 2_000_000


def unit(v: Column) -> Column:
    """A vector divided by its length, in double; a zero vector stays."""
    d = v.cast("array<double>")
    norm = F.greatest(F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)), F.lit(EPS))
    return F.transform(d, lambda x: x / norm)


def _best(r: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k best of each column; of equals the smaller ids."""
    n, m = r.shape
    if n <= k:
        return np.nonzero(np.ones_like(r, bool))
    least = np.partition(r, n - k, axis=0)[n - k]
    keep = r > least[None, :]
    room = k - keep.sum(axis=0)
    order = np.argsort(ids, kind="stable")
    ties = r[order] == least[None, :]
    keep[order] |= ties & (np.cumsum(ties, axis=0) <= room[None, :])
    return np.nonzero(keep)


def _chunked(rows: DataFrame, size: int) -> DataFrame:
    """(ids, data, n): vectors (id: long, embedding) in chunks of up to ``size``, each as the bytes of its ids and its
    matrix in double."""

    def run(batches):
        def chunk(ids, parts):
            return pa.RecordBatch.from_arrays([pa.array([b"".join(ids)], pa.binary()), pa.array([b"".join(parts)], pa.binary()), pa.array([sum(map(len, ids)) // 8], pa.int32())], names=["ids", "data", "n"])

        ids, parts, n = [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - n)
                at, n = at + part.num_rows, n + part.num_rows
                ids.append(part.column(0).to_numpy().astype(np.int64).tobytes())
                parts.append(part.column(1).flatten().to_numpy().astype(np.float64).tobytes())
                if n == size:
                    yield chunk(ids, parts)
                    ids, parts, n = [], [], 0
        if n:
            yield chunk(ids, parts)

    return map_texts(rows.select(F.col(rows.columns[0]).cast("long"), rows.columns[1]), run, "ids binary, data binary, n int")


def search(queries: DataFrame, vectors: DataFrame, k: int = DEPTH) -> DataFrame:
    """(query_id, rank, id, cosine): the k nearest of all ``vectors`` (id, embedding) for every query (query_id, embedding).

    Both sides are cut into blocks, and every two blocks are one product, of which the k best of each query go on to one
    more selection. The blocks of the queries are broadcast if they are known to be few; the driver sees their number only.
    """
    blocks = stage(_chunked(queries.select("query_id", "embedding"), QUERY_BLOCK), "queries").withColumnsRenamed({"ids": "q_ids", "data": "q_data", "n": "m"})
    size = blocks.agg(F.sum(F.length("q_data"))).first()[0] or 0

    def unit_rows(data: bytes, n: int) -> np.ndarray:
        x = np.frombuffer(data, np.float64).reshape(n, -1)
        return x / np.maximum(np.sqrt((x * x).sum(axis=1)), EPS)[:, None]

    def run(batches):
        last, held = None, tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        for batch in batches:
            for ids, data, n, q_ids, q_data, m in zip(*(batch.column(i) for i in range(6))):
                if last is None or not last[0].equals(ids):
                    last = ids, unit_rows(data.as_buffer(), n.as_py())
                own, asked = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(q_ids.as_buffer(), np.int64)
                s = last[1] @ unit_rows(q_data.as_buffer(), m.as_py()).T
                keep = _best(np.round(s, DIGITS), own, k)
                held = tuple(np.concatenate(x) for x in zip(held, (asked[keep[1]], own[keep[0]], s[keep])))
                best = best_rows(*held, k)
                held = tuple(x[best] for x in held)
                if len(best) > HELD_ROWS:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held)), names=["query_id", "id", "cosine"])
                    held = tuple(x[:0] for x in held)
        yield pa.RecordBatch.from_arrays(list(map(pa.array, held)), names=["query_id", "id", "cosine"])

    met = _chunked(vectors.select("id", "embedding"), ROW_BLOCK).crossJoin(F.broadcast(blocks) if size <= BROADCAST_BYTES else blocks)
    return top_k(map_texts(met, run, "query_id long, id long, cosine double"), "cosine", k)


def append_vectors(vectors: DataFrame, path: str, dim: int = EMBED_DIM) -> None:
    """Add unit vectors (id, embedding) to a table. A vector of another length is an error, and nothing is added."""
    made = vectors.select("id", unit(F.col("embedding")).cast("array<float>").alias("embedding"))
    wrong = made.where(F.coalesce(F.size("embedding"), F.lit(-1)) != dim)
    if not wrong.isEmpty():
        raise ValueError(f"vectors of {dim} components are kept here")
    made.write.mode("append").parquet(path)


def hash_buckets(text: Column, dim: int = EMBED_DIM) -> Column:
    """The bucket of every word of a text in lower case, without . , ? at its ends: its MD5 as a number modulo dim."""
    parts = F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")
    clean = F.transform(parts, lambda w: F.regexp_replace(w, "^[.,?]+|[.,?]+$", ""))

    def bucket(h: Column) -> Column:
        # The digits are more than a long holds: the remainder is carried from piece to piece.
        rest = F.lit(0).cast("long")
        for i in range(4):
            rest = (rest * (1 << 32) + F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")) % dim
        return rest.cast("int")

    return F.transform(F.transform(clean, F.md5), bucket)


def hash_vectors(docs: DataFrame, key: str, text: str = "text", dim: int = EMBED_DIM) -> DataFrame:
    """Sparse unit vectors (id, bucket, weight) of the word counts by bucket; a text without words has no rows. The words of a text
    lie in its row and are counted there; texts of which several have the same key count as one, and only these are shuffled."""

    def run(batches):
        for batch in batches:
            hold(HASHED, _buckets.clear)
            found = [Counter(map(_buckets[dim].__getitem__, (t or "").split())) for t in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), np.fromiter(map(len, found), np.int64, len(found)))
            buckets, counts = pa.array([x for c in found for x in c], pa.int32()), np.array([x for c in found for x in c.values()], np.int64)
            norms = np.sqrt(np.bincount(at, counts * counts, len(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), buckets, pa.array(counts), pa.array(counts / norms[at])], names=["id", "bucket", "c", "weight"])

    rows = docs.select(F.col(key).alias("id"), F.lower(text).alias("t"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, bucket int, c long, weight double"
    several = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if several.isEmpty():
        return map_texts(rows, run, kind, HASHED).select("id", "bucket", "weight")
    again = several.select(F.col("id").alias("mr_id"))
    same = F.col("id").eqNullSafe(F.col("mr_id"))
    one = map_texts(rows.join(again, same, "left_anti"), run, kind, HASHED).select("id", "bucket", "weight")
    counts = map_texts(rows.join(again, same, "left_semi"), run, kind, HASHED).groupBy("id", "bucket").agg(F.sum("c").alias("c"))
    norms = counts.groupBy(F.col("id").alias("mr_id")).agg(F.sqrt(F.sum(F.col("c") * F.col("c")).cast("double")).alias("norm"))
    return one.unionByName(counts.join(norms, same).select("id", "bucket", (F.col("c") / F.col("norm")).alias("weight")))


#: Whose tasks remember the buckets of words in a worker; those of others let them go.
HASHED = "hashed words"


class _Buckets(dict):
    """The bucket of a word as ``hash_buckets`` has it. Words repeat: their buckets are remembered, and found without a call of Python."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        got = self[word] = int.from_bytes(hashlib.md5(word.strip(".,?").encode()).digest()) % self.dim
        return got


class _ByDim(dict):
    def __missing__(self, dim: int) -> _Buckets:
        got = self[dim] = _Buckets(dim)
        return got


_buckets = _ByDim()


def hash_embeddings(docs: DataFrame, key: str, text: str = "text", dim: int = EMBED_DIM) -> DataFrame:
    """The same vectors whole: (id, embedding), zeros for a text without words. One pass, no shuffle."""

    def run(batches):
        for batch in batches:
            hold(HASHED, _buckets.clear)
            for at in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                n = part.num_rows
                found = [(t or "").split() for t in part.column(1).to_pylist()]
                lens = np.fromiter(map(len, found), np.int64, n)
                flat = np.repeat(np.arange(n), lens) * dim + np.fromiter(map(_buckets[dim].__getitem__, chain.from_iterable(found)), np.int64, lens.sum())
                x = np.bincount(flat, minlength=n * dim).reshape(n, dim).astype(np.float64)
                x /= np.maximum(np.sqrt((x * x).sum(axis=1)), EPS)[:, None]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim), pa.int32()), pa.array(x.ravel()))], names=["id", "embedding"])

    return map_texts(docs.select(F.col(key).cast("long").alias("id"), F.lower(text).alias("t")), run, "id long, embedding array<double>", HASHED)


def cosines(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` (query_id, id and more) with the cosine of the two unit vectors: queries (query_id, embedding), vectors (id, embedding)."""
    q = queries.select("query_id", F.col("embedding").alias("mr_q"))
    both = pairs.join(q, "query_id").join(vectors.select("id", F.col("embedding").alias("mr_v")), "id")
    return both.withColumn("cosine", F.aggregate(F.zip_with("mr_q", "mr_v", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)).drop("mr_q", "mr_v")
