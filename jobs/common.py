"""What the jobs share: their command line, settings that are put back, tables that may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
from contextlib import contextmanager
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: Settings that the library's operators change while they work. (A shared folder that is unset stays set: later work needs it.)
CHANGED = ("spark.sql.execution.arrow.maxBytesPerBatch",)


def defaults(job: str) -> dict:
    """The configuration beside a job's file."""
    return json.loads(Path(__file__).with_name(f"{job}.json").read_text())


@contextmanager
def settings_kept(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in CHANGED}
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that the job has written; an empty one if it hasn't yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def main(job: str, about: str, paths: dict[str, str], run) -> None:
    """Run a job from the command line, in a session of its own. paths: the names and meanings of its path arguments."""
    p = argparse.ArgumentParser(description=about.splitlines()[0])
    for name, what in paths.items():
        p.add_argument(f"--{name}", required=True, help=what)
    p.add_argument("--config", help=f"JSON with any of the keys of jobs/{job}.json")
    args = vars(p.parse_args())
    at = args.pop("config")
    config = defaults(job) | (json.loads(Path(at).read_text()) if at else {})
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(job).getOrCreate()
    try:
        run(spark, config=config, **args)
    finally:
        spark.stop()
