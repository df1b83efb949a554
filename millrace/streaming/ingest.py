"""Files that keep arriving: a stream into a corpus store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.corpus import Store
from millrace.sources.extract import extract
from millrace.sources.gates import gate


def stream_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(name, declared_size, content) of files as they appear under a path."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(kind).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("declared_size"), "content")


def ingest_stream(files: DataFrame, store: Store, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Gate, extract and add every batch of files. The store keeps the stream's id and the number of its last batch in the
    snapshot that the batch made, so a batch that comes again after a failure is known as a whole and adds nothing."""

    def add(batch: DataFrame, number: int) -> None:
        # The id stays with the checkpoint, over restarts.
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        store.ingest(extract(gate(batch)), (stream, number))

    writer = files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
