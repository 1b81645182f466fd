"""As-of, range and overlap joins by equal keys and bins, and set operations that count repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.plans.session import materialized

#: Rows that one row of a counted set is expanded to in one step.
_CHUNK = 1 << 16


def _number(at: Column, kind: str) -> Column:
    """Times as seconds, other orderable values as they are."""
    return at.cast("timestamp").cast("double") if kind.startswith("timestamp") else F.unix_date(at).cast("double") * 86_400 if kind == "date" else at.cast("double")


def _kind(df: DataFrame, at: Column) -> str:
    return df.select(at.alias("at")).schema["at"].dataType.simpleString()


def as_of_join(
    left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, take: dict[str, str], width: float = 86_400.0, tie: list[str] | None = None, tolerance: float | None = None
) -> DataFrame:
    """Each row of left with columns of the latest row of right that has the same keys and is not later.

    `take` maps columns of right to their names in the result. Both sides are put in one order by key
    and time, and the last row of right is carried along. The order is cut into spans of `width` (seconds
    for times), each a group of its own that starts from the last row of right in earlier spans: so a
    key, however hot, is spread over its spans. Per key and span one row is carried over.

    Of rows of right at one time the greatest by `tie`, then by the columns taken, counts. Rows older
    than `tolerance` don't match. Null keys and null times match nothing; rows of left all stay, repeated
    ones, too. Only the columns named are read from right, so its other names can't clash.
    """
    if clash := set(take.values()) & set(left.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    kind = _kind(left, F.col(left_at))
    keys = [f"__k{k}" for k in range(len(on))]
    named = lambda: [F.col(c).alias(k) for c, k in zip(on, keys, strict=True)]
    value = F.struct(F.col(right_at).alias("at"), F.struct(*[F.col(c) for c in tie or []], F.lit(0).alias("none")).alias("tie"), F.struct(*[F.col(c).alias(n) for c, n in take.items()]).alias("taken"))
    ours = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    l = left.select(*named(), F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("__right"), ours.alias("__left"))  # noqa: E741
    r = right.select(*named(), F.col(right_at).alias("__at"), F.lit(0).alias("__side"), value.alias("__right"), F.lit(None).cast(l.schema["__left"].dataType).alias("__left"))
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in [*keys, "__at"]])
    both = l.where(known).unionByName(r.where(known)).withColumn("__span", F.floor(_number(F.col("__at"), kind) / width))
    spans = both.groupBy(*keys, "__span").agg(F.max("__right").alias("__last"))
    earlier = W.partitionBy(*keys).orderBy("__span").rowsBetween(W.unboundedPreceding, -1)
    carried = spans.select(*[F.col(k).alias(f"{k}_c") for k in keys], F.col("__span").alias("__span_c"), F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
    inside = W.partitionBy(*keys, "__span").orderBy("__at", "__side", F.col("__right")).rowsBetween(W.unboundedPreceding, 0)
    held = both.withColumn("__held", F.last("__right", ignorenulls=True).over(inside)).where("__side = 1")
    same = reduce(Column.__and__, [F.col(k) == F.col(f"{k}_c") for k in [*keys, "__span"]])
    found = held.join(carried, same, "left").select("__left", "__at", F.coalesce("__held", "__carried").alias("__found"))
    near = F.lit(True) if tolerance is None else _number(F.col("__at"), kind) - _number(F.col("__found.at"), kind) <= tolerance
    taken = lambda found: [F.when(near, found["taken"][n]).alias(n) for n in take.values()]
    out = found.select(*[F.col("__left")[c].alias(c) for c in left.columns], *taken(F.col("__found")))
    nothing = l.where(~known).select(*[F.col("__left")[c].alias(c) for c in left.columns], *[F.lit(None).cast(out.schema[n].dataType).alias(n) for n in take.values()])
    return out.unionByName(nothing)


def _levels(start: Column, end: Column, width: float) -> Column:
    """The level at which a range touches five bins at most; bins of a level are twice as wide as those of the one below."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(end - start, F.lit(width)) / (4 * width)))).cast("int")


def _bins(low: Column, high: Column, level: Column, width: float) -> tuple[Column, Column]:
    size = F.lit(width) * F.pow(F.lit(2.0), level)
    return F.floor(low / size), F.floor(high / size)


def _keyed(df: DataFrame, on: list[str], prefix: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}{k}") for k, c in enumerate(on)]


def _packed(df: DataFrame, name: str) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def range_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Pairs of a point and a range with equal keys and start <= at <= end; the columns of points, then those of ranges but the keys.

    Values are cut into bins of `width` (seconds for times), so that pairs meet by equal keys. A range
    long in bins goes to a level of wider ones, where it touches five at most; a point goes to one bin
    of each level that any range uses. A pair shares one bin of one level, so it comes once. A good
    width is a typical range's length; results don't depend on it.

    Nulls in keys, points or ends match nothing, nor do ranges that end before they start. Repeated
    rows pair each. Names that both sides have, but for keys, are an error.
    """
    on = on or []
    if clash := (set(points.columns) & set(ranges.columns)) - set(on):
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    kind = _kind(points, F.col(at))
    p = points.select(*_keyed(points, on, "__p"), _number(F.col(at), kind).alias("__at"), F.col(at).alias("__exact"), _packed(points, "__point"))
    low, high = (_number(F.col(c), _kind(ranges, F.col(c))) for c in (start, end))
    r = ranges.where(F.col(start) <= F.col(end)).select(*_keyed(ranges, on, "__r"), low.alias("__low"), high.alias("__high"), F.col(start).alias("__start"), F.col(end).alias("__end"), _packed(ranges, "__range"))
    r = r.withColumn("__level", _levels(F.col("__low"), F.col("__high"), width))
    levels = sorted(x[0] for x in r.select("__level").distinct().collect())  # some sixty at most
    first, last = _bins(F.col("__low"), F.col("__high"), F.col("__level"), width)
    r = r.withColumn("__bin", F.explode(F.sequence(first, last)))
    p = p.withColumn("__plevel", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    p = p.withColumn("__pbin", _bins(F.col("__at"), F.col("__at"), F.col("__plevel"), width)[0])
    same = reduce(Column.__and__, [F.col(f"__p{k}") == F.col(f"__r{k}") for k in range(len(on))], (F.col("__plevel") == F.col("__level")) & (F.col("__pbin") == F.col("__bin")))
    pairs = p.join(r, same & (F.col("__exact") >= F.col("__start")) & (F.col("__exact") <= F.col("__end")))
    return pairs.select(*[F.col("__point")[c].alias(c) for c in points.columns], *[F.col("__range")[c].alias(c) for c in ranges.columns if c not in on])


def overlap_join(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], width: float, on: list[str] | None = None) -> DataFrame:
    """Pairs of ranges with equal keys that have a value in common, ends included; the columns of left, then those of right but the keys.

    Both sides' ranges go to the bins that they touch at a level where those are five at most; a
    range meets those of higher levels in the bins that it touches there. A pair may meet in several
    bins and counts in the one that holds the later of the two starts. Nulls and ranges that end
    before they start match nothing. Names that both sides have, but for keys, are an error.
    """
    on = on or []
    if clash := (set(left.columns) & set(right.columns)) - set(on):
        raise ValueError(f"columns of both sides: {sorted(clash)}")

    def side(df: DataFrame, ends: tuple[str, str], prefix: str) -> DataFrame:
        low, high = (_number(F.col(c), _kind(df, F.col(c))) for c in ends)
        rows = df.where(F.col(ends[0]) <= F.col(ends[1])).select(*_keyed(df, on, prefix), low.alias(f"{prefix}low"), high.alias(f"{prefix}high"), F.col(ends[0]).alias(f"{prefix}start"), F.col(ends[1]).alias(f"{prefix}end"), _packed(df, f"{prefix}row"))
        return rows.withColumn(f"{prefix}own", _levels(F.col(f"{prefix}low"), F.col(f"{prefix}high"), width))

    l, r = side(left, left_range, "__l"), side(right, right_range, "__r")  # noqa: E741
    levels = sorted({x[0] for df, c in ((l, "__lown"), (r, "__rown")) for x in df.select(c).distinct().collect()})

    def binned(df: DataFrame, prefix: str) -> DataFrame:
        at = F.explode(F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x >= F.col(f"{prefix}own")))
        df = df.withColumn(f"{prefix}level", at)
        return df.withColumn(f"{prefix}bin", F.explode(F.sequence(*_bins(F.col(f"{prefix}low"), F.col(f"{prefix}high"), F.col(f"{prefix}level"), width))))

    l, r = binned(l, "__l"), binned(r, "__r")  # noqa: E741
    # the pair's level is the higher one of its two
    same = (F.col("__llevel") == F.col("__rlevel")) & (F.col("__lbin") == F.col("__rbin"))
    same = reduce(Column.__and__, [F.col(f"__l{k}") == F.col(f"__r{k}") for k in range(len(on))], same)
    exact = (F.col("__lstart") <= F.col("__rend")) & (F.col("__rstart") <= F.col("__lend"))
    level = F.col("__llevel") == F.greatest("__lown", "__rown")
    first = _bins(F.greatest("__llow", "__rlow"), F.lit(0.0), F.col("__llevel"), width)[0] == F.col("__lbin")
    pairs = l.join(r, same & exact & level & first)
    return pairs.select(*[F.col("__lrow")[c].alias(c) for c in left.columns], *[F.col("__rrow")[c].alias(c) for c in right.columns if c not in on])


def counted(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each different row of both, with how often each side has it (n_left, n_right). Nulls are equal to each other.

    One aggregation over both sides, counted within tasks first, so a row that repeats very often is no hot spot.
    """
    names = left.columns
    if set(names) != set(right.columns):
        raise ValueError("the sides have different columns")
    if clash := set(names) & {"n_left", "n_right"}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    both = left.withColumns({"n_left": F.lit(1), "n_right": F.lit(0)}).unionByName(right.withColumns({"n_left": F.lit(0), "n_right": F.lit(1)}))
    return both.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))


def _repeated(df: DataFrame, times: Column) -> DataFrame:
    """Each row so many times, in two steps, so that no row grows into an array of unbounded length."""
    names = df.columns
    df = df.withColumn("__times", times.cast("long")).where("__times > 0")
    df = df.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__times") - 1) / _CHUNK))))
    df = df.withColumn("__one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(_CHUNK).cast("long"), F.col("__times") - F.col("__chunk") * _CHUNK))))
    return df.select(*[F.col(f"`{c}`") for c in names])


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row as often as both sides have it."""
    return _repeated(counted(left, right), F.least("n_left", "n_right")).drop("n_left", "n_right")


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row as often as left has it more often than right."""
    return _repeated(counted(left, right), F.col("n_left") - F.col("n_right")).drop("n_left", "n_right")


def table_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows that the tables hold in different numbers: the columns, `change` (added or removed) and how many times."""
    rows = counted(old, new).withColumn("times", F.abs(F.col("n_right") - F.col("n_left"))).where("times > 0")
    return rows.withColumn("change", F.when(F.col("n_right") > F.col("n_left"), "added").otherwise("removed")).drop("n_left", "n_right")


def cube_counts(df: DataFrame, keys: list[str], distinct: str, least: int = 1) -> DataFrame:
    """Of each subset of the keys the groups with `least` rows or more: the keys (null where left out), `grouping` (a bit for each
    key left out, the last key's lowest), n_rows, n_distinct.

    Rows are counted by all keys and the distinct column first, so what is expanded to the subsets, and
    what the grand total aggregates, are groups and not rows. A null in a key is a value of its own; `grouping` tells
    it from a total. As in SQL nulls of the distinct column aren't counted, and an empty table has a
    grand total of no rows.
    """
    base = df.groupBy(*[F.col(f"`{k}`").alias(f"__k{n}") for n, k in enumerate(keys)], F.col(f"`{distinct}`").alias("__d")).agg(F.count(F.lit(1)).alias("__n"))
    base = materialized(base)
    size = len(keys)
    sets = F.explode(F.array(*[F.lit(g) for g in range(1 << size)])).alias("grouping")
    masked = [F.when(F.col("grouping").bitwiseAND(F.lit(1 << (size - 1 - n))) == 0, F.col(f"__k{n}")).alias(f"__m{n}") for n in range(size)]
    expanded = base.select("*", sets).select("grouping", *masked, "__d", "__n")
    by_value = expanded.groupBy("grouping", *[f"__m{n}" for n in range(size)], "__d").agg(F.sum("__n").alias("__n"))
    groups = by_value.groupBy("grouping", *[f"__m{n}" for n in range(size)]).agg(F.sum("__n").alias("n_rows"), F.count("__d").alias("n_distinct"))
    if base.isEmpty():
        none = [F.lit(None).cast(df.schema[k].dataType).alias(f"__m{n}") for n, k in enumerate(keys)]
        groups = df.sparkSession.range(1).select(F.lit((1 << size) - 1).alias("grouping"), *none, F.lit(0).cast("long").alias("n_rows"), F.lit(0).cast("long").alias("n_distinct"))
    return groups.where(F.col("n_rows") >= least).select(*[F.col(f"__m{n}").alias(k) for n, k in enumerate(keys)], "grouping", "n_rows", "n_distinct")
