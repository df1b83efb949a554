"""A two-dimensional map of unit vectors from their uncentred Gram matrix."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(i, j, g): the sum over all rows of the product of components i and j, in double.

    Each partition adds up its own matrix; only those meet in a shuffle.
    """

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            d = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(d), d), pa.int32()), pa.array(np.tile(np.arange(d), d), pa.int32()), pa.array(total.ravel())], names=["i", "j", "g"])

    return vectors.select(column).mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def matrix(g: DataFrame) -> np.ndarray:
    """The d x d values of a Gram matrix (i, j, g), of which there is one at least."""
    t = g.toArrow()
    i, j = t["i"].to_numpy(), t["j"].to_numpy()
    out = np.zeros((int(i.max()) + 1,) * 2)
    out[i, j] = t["g"].to_numpy()
    return out


@dataclass(frozen=True)
class SpectralMap:
    """Two axes (their largest component positive), all singular values, and the share of the two in the total."""

    axes: np.ndarray
    sigma: np.ndarray
    eta: float
    n_rows: int

    @staticmethod
    def fit(vectors: DataFrame, column: str = "embedding") -> SpectralMap:
        n = vectors.count()
        if not n:
            raise ValueError("no rows to fit")
        return SpectralMap.of_gram(matrix(gram(vectors, column)), n)

    @staticmethod
    def of_gram(g: np.ndarray, n: int) -> SpectralMap:
        """From a Gram matrix, which may be the sum of those of several batches. One row has a second axis of zeros."""
        values, vectors = np.linalg.eigh(g)
        keep = min(n, len(g))
        values, vectors = np.clip(values[::-1][:keep], 0, None), vectors[:, ::-1][:, :keep]
        axes = np.zeros((len(g), 2))
        for k in range(min(2, keep)):
            v = vectors[:, k]
            axes[:, k] = v * np.sign(v[np.abs(v).argmax()])
        total = values.sum()
        return SpectralMap(axes, np.sqrt(values), float(values[:2].sum() / total) if total else 0.0, n)

    def project(self, v: Column) -> tuple[Column, Column]:
        """(x, y) of a vector column."""
        d = v.cast("array<double>")
        dot = lambda k: F.aggregate(F.zip_with(d, F.array(*[F.lit(float(x)) for x in self.axes[:, k]]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return dot(0), dot(1)

    def save(self, spark, path: str) -> None:
        row = (self.axes[:, 0].tolist(), self.axes[:, 1].tolist(), self.sigma.tolist(), self.eta, self.n_rows)
        spark.createDataFrame([row], "v1 array<double>, v2 array<double>, sigma array<double>, eta double, n long").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> SpectralMap:
        r = spark.read.parquet(path).first()
        return SpectralMap(np.array([r["v1"], r["v2"]]).T, np.array(r["sigma"]), r["eta"], r["n"])

    def points(self, vectors: DataFrame, hits: DataFrame | None = None, max_points: int = 1500, seed: int = 0) -> DataFrame:
        """(id, x, y) of all rows, or of a seeded sample of max_points and the rows in ``hits`` (id).

        The sample is the rows of the smallest hashes: the same for every partitioning.
        """
        chosen = vectors
        if self.n_rows > max_points:
            ids = vectors.select("id").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(max_points)
            ids = ids.union(hits.select("id")).distinct() if hits is not None else ids
            chosen = vectors.join(F.broadcast(ids) if hits is None else ids, "id", "left_semi")
        x, y = self.project(F.col("embedding"))
        return chosen.select("id", x.alias("x"), y.alias("y"))
