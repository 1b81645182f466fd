"""Row numbers, shuffles, splits, shards and batches, all reproducible and without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.text import shuffle_key
from granary.plans.session import materialized


def positions(df: DataFrame, order: list[Column], name: str = "position", start: int = 0, key: list[str] | None = None) -> DataFrame:
    """Adds dense numbers from `start` in the given order; nulls come first, as in any ascending sort.

    Rows are dealt by range and sorted within partitions; what is summed up afterwards is one row
    count for each partition, and only those are broadcast. All columns of df are written to the
    checkpoint folder once. For wide rows name a `key`, columns that tell rows apart and have no
    nulls: then only these are numbered, and joined back.

    Without a key repeated rows get a number each, in any order among equals (name enough order
    columns to fix it). An empty table gives an empty result. A column `name` in df is an error.
    """
    if name in df.columns:
        raise ValueError(f"column {name} exists already")
    if key:
        narrow = df.select(*key, *[o.alias(f"__order{k}") for k, o in enumerate(order)])
        return df.join(positions(narrow, [F.col(f"__order{k}") for k in range(len(order))], name, start).select(*key, name), key).select(*df.columns, name)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialized(ranged.withColumns({"__part": F.spark_partition_id(), "__seq": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = ranged.join(F.broadcast(offsets), F.col("__part") == F.col("__p"))
    return numbered.withColumn(name, F.col("__before") + F.col("__seq") + start).drop("__part", "__p", "__seq", "__before")


def row_ids(df: DataFrame, order: list[Column], name: str = "doc_id", start: int = 0) -> DataFrame:
    """Dense ids as the first column; an existing column of that name is an error."""
    numbered = positions(df, order, name, start)
    return numbered.select(name, *df.columns)


def shuffled(df: DataFrame, ids: list[str], seed: int = 42) -> DataFrame:
    """Positions of a full pseudo-random shuffle."""
    return positions(df, [shuffle_key(seed, *map(F.col, ids)), *map(F.col, ids)])


def buffered_shuffle(df: DataFrame, order: list[Column], ids: list[str], buffer: int = 32_768, seed: int = 42) -> DataFrame:
    """Consecutive runs of `buffer` rows, each shuffled in itself; position is the new place. Nulls come first, as in positions; repeated rows have a place each."""
    placed = positions(df, order, "__old").withColumn("__chunk", F.floor(F.col("__old") / buffer))
    inside = W.partitionBy("__chunk").orderBy(shuffle_key(seed, *map(F.col, ids)), *ids)
    return placed.withColumn("position", F.col("__chunk") * buffer + F.row_number().over(inside) - 1).drop("__old", "__chunk")


def holdout(df: DataFrame, valid_size: int, total: int) -> DataFrame:
    """The last valid_size positions are validation; all of them if there are no more rows than that."""
    return df.withColumn("split", F.when((F.lit(total) <= valid_size) | (F.col("position") >= total - valid_size), "valid").otherwise("train"))


def ratio_bounds(total: int, ratios: tuple[float, float, float]) -> tuple[int, int]:
    """First positions of the second and third part; ratios that don't sum to 1 are normalised."""
    whole = sum(ratios)
    if abs(whole - 1.0) > 1e-5:
        ratios = tuple(r / whole for r in ratios)
    first = int(total * ratios[0])
    return first, first + int(total * ratios[1])


def ratio_split(df: DataFrame, total: int, ratios: tuple[float, float, float] = (0.6, 0.25, 0.15), names: tuple[str, str, str] = ("main", "aux", "debug")) -> DataFrame:
    a, b = ratio_bounds(total, ratios)
    at = F.col("position")
    return df.withColumn("split", F.when(at < a, names[0]).when(at < b, names[1]).otherwise(names[2]))


def sequential_bounds(total: int, extra: int, ratios: tuple[float, float, float] = (0.6, 0.25, 0.15)) -> tuple[int, int, int, int]:
    """Ends of the four consecutive parts; rows beyond the last are left over.

    The extra part is cut from the first. Where the first is smaller than that it is empty, and the
    parts after it keep their sizes.
    """
    train, second, third = int(total * ratios[0]) - extra, int(total * ratios[1]), int(total * ratios[2])
    allocated = train + second + third
    extra = min(extra, total - allocated)
    if allocated + extra > total:
        raise ValueError("the parts exceed the rows")
    first = max(0, train)
    return first, first + second, first + second + third, first + second + third + extra


def sequential_split(df: DataFrame, total: int, extra: int = 10_000, names: tuple[str, ...] = ("train", "second", "third", "extra")) -> DataFrame:
    """Consecutive parts by position; leftover rows are dropped."""
    ends = sequential_bounds(total, extra)
    part = F.lit(None).cast("string")
    for name, end in reversed(list(zip(names, ends, strict=True))):
        part = F.when(F.col("position") < end, name).otherwise(part)
    return df.withColumn("split", part).where(F.col("split").isNotNull())


def batches(df: DataFrame, size: int, skip: int = 0, accumulate: int = 1) -> DataFrame:
    """Adds batch and accumulation group by position; the first `skip` batches are left out, as are rows without a position."""
    numbered = df.withColumn("batch", F.floor(F.col("position") / size))
    return numbered.where(F.col("batch") >= skip).withColumn("group", F.floor(F.col("batch") / accumulate))


def stacked(df: DataFrame, arrays: list[str]) -> DataFrame:
    """One row for each batch: the arrays of its rows in order, null ones included. A batch has a fixed number of rows; further columns are left out."""
    rows = F.sort_array(F.collect_list(F.struct("position", *arrays)))
    return df.groupBy("batch").agg(rows.alias("__rows")).select("batch", *[F.col(f"__rows.{a}").alias(a) for a in arrays])


def latest(df: DataFrame, k: int, by: Column, tie: Column, *group: str) -> DataFrame:
    """The k latest rows (of each group, null being one); adds `age` from 1. Nulls are the oldest. Without a group only k rows of each partition are compared."""
    if not group:
        df = df.orderBy(by.desc(), tie.desc()).limit(k)
    newest = W.partitionBy(*group).orderBy(by.desc(), tie.desc())
    return df.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= k)


def progress_total(rows: int, epochs: int, batch: int, interval: int) -> int:
    return rows * epochs // (batch * interval)
