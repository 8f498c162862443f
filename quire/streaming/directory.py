"""Beyond parity: new files of a directory as a stream, parsed batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.sources.files import accepted


BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, directory: str, max_files: int = 1000) -> DataFrame:
    """(path, modificationTime, length, content, name, stem, kind) of files as they arrive, a bounded number a batch."""
    got = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", max_files).load(directory)
    return accepted(got)


def parse_stream(files: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hands each batch to `handle(batch, id)`. Batches are numbered and a failed one comes again under its
    number, so a handler that overwrites by id writes each file once."""
    writer = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
