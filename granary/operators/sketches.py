"""Mergeable sketches as stored columns: distinct counts by registers, quantiles by logarithmic buckets.

Both are exact in merging: sketches of parts, merged, equal the sketch of the whole, however the rows
are dealt and however often they are merged. Errors: a distinct count has a standard error of
1.04 / sqrt(2**PRECISION) (1.6 %), a quantile is within ALPHA (1 %) of a value of its rank.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a hash that choose one of 4,096 registers, and those in which leading zeros are counted.
PRECISION, _REST = 12, 48
#: Relative error of quantiles.
ALPHA = 0.01
_GAMMA = (1 + ALPHA) / (1 - ALPHA)
_STEP = math.log(_GAMMA)
#: Values closer to zero than this are zero.
_LEAST = 1e-9


def _as_map(df: DataFrame, keys: list[str], key: str, value: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias(name))


def distinct_sketch(df: DataFrame, value: Column, *keys: str, name: str = "sketch") -> DataFrame:
    """(keys, sketch): for each group the registers that are set, map<int,int>. Nulls aren't counted; a group of nulls has an empty one.

    Rows are reduced to registers within tasks first, so a hot group shuffles 4,096 numbers a task.
    """
    digest = F.md5(value.cast("string"))
    register = F.conv(F.substring(digest, 1, PRECISION // 4), 16, 10).cast("int")
    rest = F.conv(F.substring(digest, PRECISION // 4 + 1, _REST // 4), 16, 10).cast("long")
    rank = F.when(rest == 0, _REST + 1).otherwise(_REST - F.length(F.bin(rest)) + 1).cast("int")
    rows = df.select(*keys, register.alias("register"), rank.alias("rank")).groupBy(*keys, "register").agg(F.max("rank").alias("rank"))
    return _sketched(rows, list(keys), name)


def _sketched(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    entries = F.collect_list(F.when(F.col("register").isNotNull(), F.struct("register", "rank")))
    return rows.groupBy(*keys).agg(F.map_from_entries(F.sort_array(entries)).alias(name))


def merge_distinct(sketches: DataFrame, *keys: str, name: str = "sketch") -> DataFrame:
    """(keys, sketch): the sketches of each group in one."""
    rows = sketches.select(*keys, F.explode_outer(name).alias("register", "rank")).groupBy(*keys, "register").agg(F.max("rank").alias("rank"))
    return _sketched(rows, list(keys), name)


def distinct_estimate(sketch: Column) -> Column:
    """The number of different values: harmonic mean of the registers, or by empty registers where those are many."""
    m = 1 << PRECISION
    alpha = 0.7213 / (1 + 1.079 / m)
    empty = m - F.size(sketch)
    total = F.aggregate(F.map_values(sketch), empty.cast("double"), lambda a, r: a + F.pow(F.lit(2.0), -r.cast("double")))
    raw = alpha * m * m / total
    return F.when((raw <= 2.5 * m) & (empty > 0), m * F.log(m / empty)).otherwise(raw)


def bucket_of(value: Column) -> Column:
    """The bucket of a number: 0 for zero, above it for positive ones and below it for negative ones, by the logarithm of their size.

    Sizes from 1e-9 on are told apart.
    """
    size = F.ceil(F.round(F.log(F.abs(value) / _LEAST) / _STEP, 9)) + 1
    return F.when(F.abs(value) < _LEAST, 0).otherwise(F.signum(value) * size).cast("int")


def bucket_value(bucket: Column) -> Column:
    middle = 2 * F.pow(F.lit(_GAMMA), F.abs(bucket) - 2) * _GAMMA / (_GAMMA + 1) * _LEAST
    return F.when(bucket == 0, 0.0).otherwise(F.signum(bucket) * middle)


def quantile_sketch(df: DataFrame, value: Column, *keys: str, name: str = "sketch") -> DataFrame:
    """(keys, sketch): numbers of values by bucket, map<int,bigint>. Nulls and NaN aren't counted; buckets are some thousands at most."""
    rows = df.select(*keys, F.when(~F.isnan(value.cast("double")), bucket_of(value.cast("double"))).alias("bucket"))
    return _bucketed(rows.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n")), list(keys), name)


def _bucketed(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    entries = F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", "n")))
    return rows.groupBy(*keys).agg(F.map_from_entries(F.sort_array(entries)).alias(name))


def merge_quantiles(sketches: DataFrame, *keys: str, name: str = "sketch") -> DataFrame:
    rows = sketches.select(*keys, F.explode_outer(name).alias("bucket", "n")).groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    return _bucketed(rows, list(keys), name)


def quantile(sketch: Column, share: float) -> Column:
    """A value within ALPHA of the one of rank ceil(share * n), the least at 0; null for an empty sketch."""
    entries = F.array_sort(F.map_entries(sketch))
    n = F.aggregate(F.map_values(sketch), F.lit(0).cast("long"), lambda a, x: a + x)
    rank = F.greatest(F.ceil(n * F.lit(share)), F.lit(1))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("bucket"))
    found = F.aggregate(entries, start, lambda a, e: F.struct((a["seen"] + e["value"]).alias("seen"), F.when(a["seen"] >= rank, a["bucket"]).otherwise(e["key"]).alias("bucket")))
    return bucket_value(found["bucket"])
