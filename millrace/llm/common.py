"""What the operators of this subpackage share: staging, table loading, constants."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.staging import settled, shared_dir, stage, unstage  # noqa: F401
from millrace.functions.tables import load, map_texts, spread  # noqa: F401

#: Word separators of every word rule here: the six ASCII blanks. ``bytes.split()`` splits on the same six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(load(spark, sf_dir, name))


def shielded(*outputs: str, own: tuple[str, ...] = ()):
    """For an operator on a table: input columns with the names of its ``outputs`` are replaced, and others pass
    through unchanged, though they have names that it uses inside: those that begin with mr_, and ``own``."""

    def wrap(f):
        @wraps(f)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            docs = docs.drop(*[c for c in docs.columns if c.lower() in outputs])
            hidden = {c: f"kept_{i}_{c}" for i, c in enumerate(docs.columns) if c.lower().startswith("mr_") or c.lower() in own}
            out = f(docs.withColumnsRenamed(hidden), *args, **kwargs)
            return out.withColumnsRenamed({v: k for k, v in hidden.items()})

        return run

    return wrap


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash60(*parts: Column | str) -> Column:
    """The first 15 hex digits of the MD5 of the parts, joined by colons, as a long from 0 to 2^60 - 1.

    Chosen because any SQL engine can recompute it. A null part counts as the word null.
    """
    text = F.concat_ws(":", *[F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
