"""Reading the tables of a folder, and mapping over texts in batches of bounded size."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch of whole texts, on both sides of the Python worker's pipe.
BATCH_BYTES = 8 << 20


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if its files make fewer: for small tables in one file
    whose rows cost much to work on. A large table is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def map_texts(df: DataFrame, run, schema, owner: str | None = None) -> DataFrame:
    """``df.mapInArrow`` in batches by bytes: a batch of rows may hold any number of them. Sets the session's
    spark.sql.execution.arrow.maxBytesPerBatch, which is read when the plan runs. A worker gives back the memory that
    is free after its task, and lets go what tasks of another ``owner`` hold, as it stays for the next one, which may be of
    another kind."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def trimmed(batches):
        let_go(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(trimmed, schema)


#: owner -> what lets go of the tables that its tasks keep in this worker.
_held: dict = {}


def hold(owner: str, release) -> None:
    """Note that tasks of an owner keep something in this worker, which ``release`` lets go."""
    _held[owner] = release


def let_go(owner: str | None) -> None:
    """Release what tasks of other owners keep in this worker."""
    for other in [o for o in _held if o != owner]:
        _held.pop(other)()


def give_back() -> None:
    """Free memory that the allocators of this process hold, to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass
