"""Rasters that arrive in a folder, as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mosaiq.sources import raster


def stream_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def stream_directories(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """A row for each directory of each arriving file; stateless, so it appends."""
    return raster.directories(stream_files(spark, path, glob))


def for_each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Run sink on each micro-batch until what has arrived is done; progress is kept in the checkpoint."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
