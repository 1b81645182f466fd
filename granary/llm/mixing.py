"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

A source's target is its weight's share of all sizes, capped at a number of epochs of the source;
what lies above a cap is shared anew by weight among the others until no source is above its cap.
A source takes as many complete epochs as fit its target. The rest of its budget is a weighted
sample without replacement: each document draws an exponential key scaled by its quality weight,
-ln(u) / weight, with u from a hash of the id; in the order of their keys, each document is taken
that fits what the documents before it have left of the budget.

This goes in rounds. A round takes, of the documents that fit what is left, those whose prefix sum
fits, too; the one that crosses fits no more, and neither does any passed over before, so the next
round goes on behind it. Rounds end when no source has a document left that fits, or when
so few rows of all sources together are left that one task can go through them in the same order.

The prefix sum never sorts a source in one task. Keys are dealt over a fixed number of ranges;
sizes are summed by source and range (map-side first), a running sum over those few rows finds the
range in which a source's budget ends, and only that range's documents are put in order: rows with
equal key, id and size are summed by part of the input first, so that rows of one id, however many,
are no hot spot. What is known of a source meets its rows under several salts. The sources
themselves, one row each, are sorted in one task; that holds for millions of them.

Defined results: a null text has size 0, as has an empty one; such documents take 0. Null is a
source of its own, last in the order. A null, NaN or non-positive quality weight counts as 1.
Documents with equal keys are ordered by id (null last), then by size; rows that repeat id and size
draw the same key and are taken one by one, in any order. An empty table gives an empty result.
Columns other than the id, the source and those to carry are left behind, so their names can't
clash. Reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import checkpointed


#: Tasks over which the rows of one source are spread where they meet its sums.
_SALTS = 64
#: Rows for each task of a round: later rounds have few.
_TASK = 1 << 16


@dataclass(frozen=True)
class MixSettings:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  # of the sources in order, repeating
    max_epochs: int = 3
    ranges: int = 4096
    seed: str = "mix"
    alone: int = 1 << 16  # so few rows that still fit are gone through by one task; more take another round


def targets(sizes: DataFrame, settings: MixSettings) -> DataFrame:
    """Adds each source's weight and target to rows of (source, source_size).

    With sources ordered by cap / weight, the capped ones are a prefix; the level of the others is
    what the prefix leaves of the total, by weight.
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in settings.weights])
    rows = sizes.withColumn("weight", F.element_at(weights, (1 + (F.row_number().over(ordered) - 1) % len(settings.weights)).cast("int")))
    rows = rows.withColumn("cap", (settings.max_epochs * F.col("source_size")).cast("double"))
    upward = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = upward.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({
        "__left": F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "__weights": F.sum("weight").over(upward.rowsBetween(0, W.unboundedFollowing)),
        "__place": F.row_number().over(upward),
    })
    # the first source that its level doesn't lift over its cap, and all after it, stay below theirs
    rows = rows.withColumn("__level", F.col("__left") / F.col("__weights"))
    level = F.min(F.when(F.col("__level") * F.col("weight") <= F.col("cap"), F.struct("__place", "__level"))).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))["__level"]
    return rows.withColumn("target", F.round(F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))), 6)).select("source", "source_size", "weight", "target")


def mix_sources(
    df: DataFrame, size: Column, quality: Column | None = None, id_col: str = "doc_id", source_col: str = "source", settings: MixSettings = MixSettings(), carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row for each row of df: id, source, size, source_size, target, taken (size times its epochs), and the columns to carry.

    `size` and `quality` are expressions over df.
    """
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(settings.seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    weight = F.coalesce(quality.cast("double"), F.lit(1.0)) if quality is not None else F.lit(1.0)
    weight = F.when(F.isnan(weight) | (weight <= 0), 1.0).otherwise(weight)
    docs = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.cast("long").alias("size"), (-F.log(u) / weight).alias("key"), F.struct(F.lit(0).alias("none"), *carry).alias("carried"))
    # ids, sources and numbers only: the texts are read once; the checkpoint also fixes the rows' numbers
    docs = checkpointed(docs.withColumn("row", F.monotonically_increasing_id()))
    plan = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), settings)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = checkpointed(plan.withColumn("epochs", epochs).withColumn("room", F.col("target") - F.col("epochs") * F.col("source_size")).coalesce(1))

    in_range = F.floor((1 - F.exp(-F.col("key"))) * settings.ranges).alias("range")
    left, rooms, picks = docs.select("row", "id", "source", "size", "key", in_range), plan.select("source", "room"), []
    while True:
        fits = checkpointed(_known(left, rooms).where((F.col("size") > 0) & (F.col("size") <= F.col("room"))))
        rows = fits.count()
        if not rows:
            break
        if rows <= settings.alone:
            picks.append(checkpointed(_one_by_one(fits)))
            break
        tasks = 1 + rows // _TASK
        got = checkpointed(_prefixes(fits.coalesce(tasks)).coalesce(tasks))
        picks.append(got.where("more = 1").select(F.col("row").alias("pick")))
        rooms = checkpointed(got.groupBy("source").agg((F.max("room") - F.sum(F.col("size") * F.col("more"))).alias("room")).coalesce(1))
        left = got.where("more = 0").select("row", "id", "source", "size", "key", "range")
    out = _known(docs, plan.select("source", "source_size", "target", "epochs"))
    more = F.lit(0)
    if picks:
        out = out.join(reduce(DataFrame.unionByName, picks), F.col("row") == F.col("pick"), "left")
        more = F.col("pick").isNotNull().cast("int")
    taken = (F.col("size") * (F.col("epochs") + more)).cast("long")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"), *[F.col("carried")[c].alias(c) for c in carry])


def _one_by_one(rows: DataFrame) -> DataFrame:
    """The rows taken, of a bounded number, by going through them in the order of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: dict[str | None, float] = {}
        for batch in batches:
            taken = []
            for row, source, size, room in zip(*(batch.column(c).to_pylist() for c in ("row", "source", "size", "room")), strict=True):
                now = left.get(source, room)
                if size <= now:
                    taken.append(row)
                    now -= size
                left[source] = now
            yield pa.RecordBatch.from_arrays([pa.array(taken, pa.int64())], names=["pick"])

    ordered = rows.coalesce(1).sortWithinPartitions("key", F.col("id").asc_nulls_last(), "size", "row")
    return ordered.select("row", "source", "size", "room").mapInArrow(run, "pick long")


def _known(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """Rows (with their number) and what is known of their source; rows of other sources go."""
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long")))
    by_source = by_source.withColumnRenamed("source", "__source").withColumn("__salt", salts)
    same = F.col("source").eqNullSafe(F.col("__source")) & (F.pmod("row", F.lit(_SALTS)) == F.col("__salt"))
    return rows.join(by_source, same).drop("__source", "__salt")


def _prefixes(rows: DataFrame) -> DataFrame:
    """Adds `more`, 1 for the rows of a source whose prefix sum, in the order of keys, is within its room."""
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("held"), F.max("room").alias("room"))
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    crossing = F.when(F.col("before") + F.col("held") > F.col("room"), F.struct("range", "before"))
    edges = checkpointed(ranges.groupBy("source").agg(F.min(crossing).alias("edge")).coalesce(1))  # one row a source; keeps the plan below small
    placed = checkpointed(_known(rows, edges))  # read three times below
    columns = rows.columns
    inside = placed.where(F.col("edge").isNotNull() & (F.col("range") == F.col("edge.range"))).withColumn("part", F.shiftright("row", 33))
    whole = placed.where(F.col("edge").isNull() | (F.col("range") != F.col("edge.range"))).select(*columns, (F.col("edge").isNull() | (F.col("range") < F.col("edge.range"))).cast("int").alias("more"))
    alike = ["source", "key", "id", "size", "part"]
    in_order = W.partitionBy("source").orderBy("key", F.col("id").asc_nulls_last(), "size", "part").rowsBetween(W.unboundedPreceding, -1)
    counts = inside.groupBy(*alike).agg(F.count(F.lit(1)).alias("n")).withColumn("earlier", F.coalesce(F.sum(F.col("n") * F.col("size")).over(in_order), F.lit(0)))
    counts = counts.select(*[F.col(c).alias(f"__{c}") for c in alike], "earlier")
    joined = inside.join(counts, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in alike]))
    place = F.row_number().over(W.partitionBy(*alike).orderBy("row"))
    upto = F.col("edge.before") + F.col("earlier") + place * F.col("size")
    return whole.unionByName(joined.select(*columns, (upto <= F.col("room")).cast("int").alias("more")))
