"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables (operator 5)."""

from __future__ import annotations

from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.blocks import blocks, forest, stream
from millrace.llm.common import shielded, stage, table, unstage
from millrace.llm.components import components

#: Vectors that the rotations are learned from, at most; every vector is indexed.
SAMPLE = 8192
#: Chance aimed at that a pair exactly at the threshold meets in a table, and the tables that a key can tell apart.
RECALL, MOST_TABLES = 0.995, 127
ITERATIONS, BLOCK = 30, 384


def learn_rotations(sample: np.ndarray, bits: int, seed: int = 7) -> np.ndarray:
    """A projection of ``bits`` columns: principal axes, turned so that signs lose least.

    Each rotation starts at random and alternates between the signs of the turned data and the turn that
    comes nearest to them (Procrustes), which spreads the variance evenly over the bits. As many rotations
    are learned as the bits need. The data isn't centred: that would change the angle between two vectors,
    which the threshold is about, and two near each other and the mean might share no bit.
    """
    _, axes = np.linalg.eigh(sample.T @ sample)
    v = sample @ axes
    rng, out, d = np.random.default_rng(seed), [], v.shape[1]
    for _ in range(ceil(bits / d)):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(ITERATIONS):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return np.concatenate(out, axis=1)[:, :bits]


def table_shape(rows: int, threshold: float) -> tuple[int, int]:
    """(tables, bits of each). Substrings grow with the logarithm of the rows, as bucket sizes then stay the
    same, and the tables follow from the chance that a pair at the threshold agrees in all bits of one."""
    width = min(24, max(8, round(log2(max(rows, 2))) - 2))
    while (tables := _tables(width, threshold)) > MOST_TABLES and width > 1:
        width -= 1
    return min(tables, MOST_TABLES), width


def _tables(width: int, threshold: float) -> int:
    return ceil(log(1 - RECALL) / log(1 - (1 - acos(threshold) / pi) ** width))


def chance_found(sample: np.ndarray, turn: np.ndarray, tables: int, width: int, threshold: float, seed: int = 5) -> float:
    """The share of pairs just at the threshold that meet in a table: each sample vector and one turned away
    from it, in a random direction."""
    rng = np.random.default_rng(seed)
    away = rng.standard_normal(sample.shape)
    away -= sample * np.einsum("ij,ij->i", away, sample)[:, None]
    away /= np.maximum(np.sqrt(np.einsum("ij,ij->i", away, away)), 1e-12)[:, None]
    other = threshold * sample + (1 - threshold**2) ** 0.5 * away
    same = ((sample @ turn > 0) == (other @ turn > 0)).reshape(len(sample), tables, width)
    return float(same.all(axis=2).any(axis=1).mean())


def fit_index(sample: np.ndarray, rows: int, threshold: float) -> tuple[np.ndarray, int, int]:
    """(projection, tables, bits of each): tables are added until the measured chance is RECALL. Where a key has no room
    for more of them, their bits become fewer: buckets grow then, but recall is held."""
    tables, width = table_shape(rows, threshold)
    tried = np.tile(sample, (-(-1024 // len(sample)), 1))[:2048]
    while True:
        turn = learn_rotations(sample, tables * width)
        if width == 1 or chance_found(tried, turn, tables, width, threshold) >= RECALL:
            return turn, tables, width
        if tables == MOST_TABLES:
            width -= 1
            tables = min(MOST_TABLES, _tables(width, threshold))
        else:
            tables = min(MOST_TABLES, ceil(tables * 1.4))


def _units(x: np.ndarray) -> np.ndarray:
    """Vectors (none of them zero) at length 1, scaled first, so that squares of very large or small components stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _filled(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """The vectors as rows of ``dim`` components, zeros after the end of shorter ones."""
    x = np.zeros((len(vectors), dim))
    x[np.arange(dim)[None, :] < vectors.value_lengths().to_numpy()[:, None]] = vectors.flatten().to_numpy().astype(np.float64)
    return x


def _compare(threshold: float):
    def work(block: dict):
        n = len(block["id"])
        dims = block["mr_dim"]
        flat = block["embedding"].combine_chunks().flatten().to_numpy().astype(np.float64)
        x = _units(flat.reshape(n, -1))
        cross = block["mr_i"][0] != block["mr_j"][0]
        a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        label = np.asarray(block["mr_label"].to_pylist(), object)
        ok = (label[a] == label[b]) & (dims[a] == dims[b])
        if cross:
            ok &= block["mr_chunk"][a] != block["mr_chunk"][b]
        a, b = a[ok], b[ok]
        if not len(a):
            return
        # A pair counts in the first table where it meets.
        codes = np.asarray(block["codes"].combine_chunks().flatten().to_numpy()).reshape(n, -1)
        first = (codes[a] == codes[b]).argmax(axis=1) == (block["key"][0] & 127)
        ids, count = block["id"], block["n"]
        links = np.zeros(n, np.int64)
        np.add.at(links, a[first], count[b[first]])
        np.add.at(links, b[first], count[a[first]])
        have = np.nonzero(links)[0]
        tree = forest(n, a, b)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([ids[have], [ids[p] for p, _ in tree]]).astype(np.int64)),
                pa.array([None] * len(have) + [int(ids[q]) for _, q in tree], pa.int64()),
                pa.array(np.concatenate([links[have], np.zeros(len(tree), np.int64)]).astype(np.int64)),
            ],
            names=["a", "b", "n"],
        )

    return work


@shielded("n_links", "component_id", "kept")
def vector_groups(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding, label; more columns stay).

    Vectors of equal, not null labels and equal length link at a cosine of ``threshold`` or more, in double
    precision. Null, empty and zero vectors, and those with a null or non-finite component, link with
    nothing. Equal vectors of a label are one node, so copies are never compared with each other. Others meet
    in the tables of an index of their binary codes and are verified by the original vectors, in blocks of
    bounded size. A component's id is its smallest vec_id, over nulls only null; kept compares the two null-safely.
    Input columns with the names of outputs are replaced. Repeated rows link like other copies. An empty
    table gives an empty one.
    """
    spark = vectors.sparkSession
    good = "label IS NOT NULL AND size(embedding) > 0 AND forall(embedding, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')) AND exists(embedding, v -> v <> 0)"
    usable = vectors.select("vec_id", "embedding", "label").where(good)
    # Equal vectors of a label: one node with a number of its own, fixed by writing it.
    nodes = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    nodes = nodes.select(F.monotonically_increasing_id().alias("id"), "label", F.col("label").cast("string").alias("mr_label"), F.size("embedding").alias("mr_dim"), "embedding", "least", "n")
    nodes = stage(nodes, "op5-nodes")
    shape = nodes.agg(F.count("*"), F.max("mr_dim")).first()
    edges = counts = None
    if shape[0] > 1:
        dim = shape[1]
        chosen = nodes.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE).toArrow()["embedding"].combine_chunks()
        sample = _units(_filled(chosen, dim))
        turn, tables, width = fit_index(sample, shape[0], threshold)
        weights = (1 << np.arange(width)).astype(np.int64)

        def code(batches):
            for batch in batches:
                bits = (_units(_filled(batch.column(1), dim)) @ turn > 0).reshape(batch.num_rows, tables, width)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((bits @ weights).astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["id", "codes"])

        coded = stage(nodes.select("id", "embedding").mapInArrow(code, "id long, codes array<int>"), "op5-codes")
        labelled = coded.join(nodes.select("id", "label", "mr_dim"), "id")
        # The low seven bits of a key are the table, so that labels and substrings of different tables never meet.
        slot = labelled.select("id", "label", "mr_dim", F.posexplode("codes").alias("t", "c"))
        keys = slot.select(F.expr("shiftleft(xxhash64(label, mr_dim, t, c), 7) | CAST(t AS bigint)").alias("key"), "id")
        payload = nodes.select("id", "mr_label", "mr_dim", F.expr("transform(embedding, v -> CAST(v AS double))").alias("embedding"), "n").join(coded, "id")
        work = _compare(threshold)
        found = stage(blocks(keys, payload, BLOCK).mapInArrow(lambda b: stream(b, work), "a long, b long, n long"), "op5-found")
        edges = found.where("b IS NOT NULL").select("a", "b")
        counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("others"))
    if edges is not None:
        roots = components(edges)
        named = nodes.join(roots, F.col("id") == F.col("node"), "left").join(counts, F.col("id") == F.col("a"), "left")
        named = stage(named.select("label", "embedding", "least", F.col("n").alias("copies"), F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("root", "id").alias("root")), "op5-named")
    else:
        named = nodes.select("label", "embedding", "least", F.col("n").alias("copies"), F.lit(0).cast("long").alias("others"), F.col("id").alias("root"))
    least = stage(named.groupBy("root").agg(F.min("least").alias("mr_component")), "op5-least")
    named = stage(named.join(least, "root").select(F.col("label").alias("mr_l"), F.col("embedding").alias("mr_e"), "mr_component", (F.col("copies") - 1 + F.col("others")).alias("mr_links")), "op5-classes")
    usable_row = F.expr(good)
    out = vectors.join(named, usable_row & (F.col("label") == F.col("mr_l")) & (F.col("embedding") == F.col("mr_e")), "left")
    out = out.withColumn("n_links", F.coalesce("mr_links", F.lit(0)).cast("long"))
    out = out.withColumn("component_id", F.when(F.col("mr_l").isNull(), F.col("vec_id")).otherwise(F.col("mr_component")).cast("long"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).drop("mr_l", "mr_e", "mr_component", "mr_links")


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).select("vec_id", "n_links", "component_id", "kept")


QUERIES = {"op5_vectors": op5_vectors}

ORACLE = {
    "op5_vectors": """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), l AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), n AS (
    SELECT a, count(*) AS n FROM l GROUP BY a
), r(a, b) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
    SELECT a, min(b) AS c FROM r GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""
}
