"""Journals as a stream: failures by kind and window while an export runs. An addition; batch results agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.schema import JOURNAL


def failures(spark: SparkSession, folder: str, lateness: str = "1 hour") -> DataFrame:
    """A streaming DataFrame of the records in new journal files of a folder."""
    lines = spark.readStream.schema(JOURNAL).json(folder)
    return lines.withColumn("at", F.to_timestamp("last_seen")).withWatermark("at", lateness)


def by_window(stream: DataFrame, width: str = "10 minutes") -> DataFrame:
    return stream.groupBy(F.window("at", width).alias("window"), "error_kind").agg(F.count("*").alias("n"))


def run_once(counts: DataFrame, table: str, checkpoint: str):
    """Takes all files that are there, then ends. Each batch gives the windows that it changes; the watermark ends their state."""
    return counts.writeStream.outputMode("update").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
