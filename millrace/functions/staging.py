"""Tables written to the folder that all executors share, and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where that is unset, a temporary one in local mode, in
    which all tasks run on this machine; an error on a cluster, whose executors wouldn't see it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts lineage in a way that a lost executor doesn't undo. The folder goes when the driver ends, or
    by ``unstage`` once nothing reads it any more.
    """
    spark = df.sparkSession
    path = reserve(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def reserve(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared folder; what is written there goes as staged tables do."""
    if not _staged:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def unstage(*dfs: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in dfs:
        path = getattr(df, "_millrace_path", None)
        if path:
            _remove(df.sparkSession, path)
            _staged[:] = [x for x in _staged if x[1] != path]


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """Stage what ``make`` returns, and delete all that was staged on the way to it."""
    before = {p for _, p in _staged}
    return _settle(stage(make(), label), before)


def _settle(out: DataFrame, before: set[str]) -> DataFrame:
    for spark, path in [x for x in _staged if x[1] not in before and x[1] != out._millrace_path]:
        _remove(spark, path)
        _staged.remove((spark, path))
    return out


def tidy(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` returns; staged, if it has staged anything on the way, which is then deleted."""
    before = {p for _, p in _staged}
    made = make()
    if not {p for _, p in _staged} - before:
        return made
    return _settle(stage(made, label), before)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, path in _staged:
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)
    _staged.clear()
