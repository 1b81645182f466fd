"""Sinks: JSON lines (whole, in shards of a fixed size), Parquet and sorted id lists. All overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import spaced_json
from granary.operators.ordering import positions


def json_line(df: DataFrame) -> Column:
    """Compact JSON of all columns; null fields are written."""
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def without(df: DataFrame, *names: str) -> DataFrame:
    """Leaves out the named columns; names that aren't there do no harm."""
    return df.drop(*names)


def write_jsonl(df: DataFrame, path: str, compression: str = "none", spaced: bool = False) -> None:
    """Compact lines; `spaced` ones have a space after each comma and colon. An empty table gives an empty folder."""
    line = json_line(df)
    df.select((spaced_json(line) if spaced else line).alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def shards(df: DataFrame, order: list[Column], rows: int = 300_000) -> DataFrame:
    """Adds `shard`, from 1: consecutive runs of exactly `rows` rows in the given order."""
    return positions(df, order).withColumn("shard", F.floor(F.col("position") / rows) + 1)


def write_sharded_jsonl(df: DataFrame, path: str, order: list[Column], rows: int = 300_000) -> None:
    """One folder for each shard, its rows in order in one file."""
    numbered = shards(df, order, rows)
    lines = numbered.select("shard", "position", json_line(df).alias("value"))
    lines.repartition("shard").sortWithinPartitions("shard", "position").select("shard", "value").write.mode("overwrite").partitionBy("shard").text(path)


def write_parquet(df: DataFrame, path: str, compression: str = "snappy") -> None:
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def write_ids(df: DataFrame, path: str, name: str = "doc_id") -> None:
    """Ascending over the files in the order of their names."""
    df.select(F.col(name).cast("long")).orderBy(name).select(F.col(name).cast("string")).write.mode("overwrite").text(path)
