"""Converts files of a folder as they appear or change.

Spark's file source remembers a path with its time of change, so a changed file comes again as long as its new time lies in the source's window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.text import detect_format, in_batch
from ..sources.files import canonical

SCHEMA = "path string, modificationTime timestamp, length long, content binary"
INTERVAL = "500 milliseconds"


def watched(spark: SparkSession, folder: str, batch: bool = True) -> DataFrame:
    """A stream of (path, modified, length, content, format); of the files that a batch takes only if ``batch``."""
    raw = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").load(folder)
    files = raw.select("path", F.col("modificationTime").alias("modified"), "length", "content")
    kept = files.where(in_batch(F.col("path"))) if batch else files
    return kept.withColumn("format", detect_format(F.col("path")))


def convert_stream(files: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> DataStreamWriter:
    """Every micro-batch's canonical texts go to ``handle``; errors of files are rows, not failures of the stream."""
    out = files.writeStream.foreachBatch(lambda batch, n: handle(canonical(batch), n)).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True) if once else out.trigger(processingTime=INTERVAL)


def rate(results: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Files per window and format, by their time of change; rows later than the watermark are left out."""
    return results.withWatermark("modified", late).groupBy(F.window("modified", window).alias("window"), "format").agg(F.count("*").alias("files"))
