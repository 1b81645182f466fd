"""Metric series: interval means, perplexity, accumulation sums, masked means, running bests, schedules.

Defined results: rows without a step are left out of intervals and groups. A null loss takes its place
in an interval but adds nothing to sums and means; a mean of nulls alone is null. Repeated rows count
again. Empty tables give empty results, and one row of nulls where there is no group to give.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def interval_means(df: DataFrame, step: str, loss: str, interval: int, accumulate: int = 1) -> DataFrame:
    """Mean loss and perplexity of complete intervals of steps (from 0)."""
    groups = df.where(F.col(step).isNotNull()).groupBy(F.floor(F.col(step) / interval).alias("interval")).agg(F.count(F.lit(1)).alias("n"), (F.sum(loss) / interval * accumulate).alias("mean_loss"))
    return groups.where(F.col("n") == interval).select("interval", "mean_loss", F.exp("mean_loss").alias("perplexity"))


def accumulated(df: DataFrame, step: str, loss: str, accumulate: int) -> DataFrame:
    """Loss sums of complete accumulation groups."""
    groups = df.where(F.col(step).isNotNull()).groupBy(F.floor(F.col(step) / accumulate).alias("group")).agg(F.count(F.lit(1)).alias("n"), F.sum(loss).alias("total_loss"))
    return groups.where(F.col("n") == accumulate).select("group", "total_loss")


def masked_mean(loss: Column, mask: Column) -> Column:
    """Aggregate: the mean of the losses under the mask."""
    return F.sum(loss * mask) / (F.sum(mask) + 1e-8)


def evaluation(df: DataFrame, loss: str, *group: str) -> DataFrame:
    """Unweighted mean of batch losses, and its perplexity."""
    return df.groupBy(*group).agg(F.avg(loss).alias("mean_loss")).withColumn("perplexity", F.exp("mean_loss"))


def running_best(df: DataFrame, order: list[str], value: str, group: list[str], highest: bool = False) -> DataFrame:
    """Adds the best value before each row, and whether the row improves on it; a null value is none, and improves on nothing that is there."""
    before = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    best = (F.max if highest else F.min)(value).over(before)
    better = (F.col(value) > F.col("best_before")) if highest else (F.col(value) < F.col("best_before"))
    return df.withColumn("best_before", best).withColumn("improved", F.col(value).isNotNull() & (F.col("best_before").isNull() | better))


def one_cycle(step: Column, total: int | Column, top: float, share: float = 0.3, start_divisor: float = 25.0, end_divisor: float = 1e4) -> Column:
    """Learning rate by cosine steps: up to `top` over the first share of the steps, then down."""
    turn = share * total - 1
    cosine = lambda a, b, x: b + (a - b) / 2 * (1 + F.cos(F.lit(math.pi) * x))
    low, end = top / start_divisor, top / start_divisor / end_divisor
    return F.when(step <= turn, cosine(low, top, step / turn)).otherwise(cosine(top, end, (step - turn) / (total - 1 - turn)))
