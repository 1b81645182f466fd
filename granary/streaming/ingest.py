"""Streaming forms of the tolerant JSON-lines ingest and of exact dedup, for sources that keep growing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.sources.files import valid_json


def stream_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl", files_per_trigger: int = 1000) -> DataFrame:
    """(file, line) of files as they arrive."""
    reader = spark.readStream.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("seen_at"), F.col("value").alias("line"))


def stream_valid(lines: DataFrame) -> DataFrame:
    return valid_json(lines)


def stream_dedup(df: DataFrame, content: Column, time_col: str, horizon: str) -> DataFrame:
    """The first row of each content hash; hashes are forgotten once the watermark is `horizon` past them, which bounds the state."""
    return df.withColumn("content_hash", content).withWatermark(time_col, horizon).dropDuplicatesWithinWatermark(["content_hash"])


def to_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends exactly once; runs through what is there and stops."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
