"""Bloom filters in DataFrame functions, and anti- and semi-joins that shuffle only the rows which a filter lets pass."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.plans.session import materialized

#: Words of 64 bits in a block, of which each key sets one bit; bits for each key.
_WORDS, _BITS = 8, 20
#: Most blocks: 18 MB of words. With more keys than fit, more rows pass; what passes is joined exactly.
MOST_BLOCKS = 1 << 18
#: So few keys of fixed width are broadcast themselves.
FEW = 1 << 16


def _bit(key: Column, word: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key, 6 * word).bitwiseAND(F.lit(63)).cast("int"))


@dataclass(frozen=True)
class Bloom:
    """Blocks of bits, one row each; a key's block comes from `place`, its bits from place and mark together."""

    table: DataFrame
    blocks: int

    def attach(self, df: DataFrame, *place: Column) -> DataFrame:
        """df with the words of the block of each row's place. The table is of bounded size, so it is broadcast."""
        at = F.pmod(F.xxhash64(*place, F.lit(1)), F.lit(self.blocks))
        return df.withColumn("__block", at).join(F.broadcast(self.table.withColumnRenamed("block", "__at")), F.col("__block") == F.col("__at"), "left").drop("__block", "__at")

    def detach(self, df: DataFrame) -> DataFrame:
        return df.drop(*[f"__word{k}" for k in range(_WORDS)])

    def maybe(self, *key: Column) -> Column:
        """Of attached rows: false if the key (the place, then the mark, if any) isn't among the filter's."""
        hashed = F.xxhash64(*key, F.lit(2))
        return F.coalesce(reduce(Column.__and__, [F.col(f"__word{k}").bitwiseAND(_bit(hashed, k)) != 0 for k in range(_WORDS)]), F.lit(False))


def bloom(keys: DataFrame, place: list[str], mark: list[str] | None = None, most: int = MOST_BLOCKS) -> Bloom:
    """A filter of the rows of `keys`, sized by their number. Keys may repeat; null is a value."""
    columns = [*place, *(mark or [])]
    keys = keys.select(*columns)
    blocks = min(most, max(1, -(-keys.count() * _BITS // (64 * _WORDS))))
    hashed = keys.select(F.pmod(F.xxhash64(*place, F.lit(1)), F.lit(blocks)).alias("block"), F.xxhash64(*columns, F.lit(2)).alias("key"))
    return Bloom(materialized(hashed.groupBy("block").agg(*[F.bit_or(_bit(F.col("key"), k)).alias(f"__word{k}") for k in range(_WORDS)])), blocks)


def _same(keys: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(f"__key{n}")) for n, k in enumerate(keys)])


def _listed(df: DataFrame, keys: list[str], listed: DataFrame) -> tuple[DataFrame, bool]:
    """The different keys under names of their own, and whether they can be broadcast."""
    listed = materialized(listed.select(*[F.col(f"`{k}`") for k in keys]).distinct().toDF(*[f"__key{n}" for n in range(len(keys))]))
    fixed = all(f.dataType.simpleString() in ("int", "bigint", "smallint", "tinyint", "date", "timestamp", "boolean") for f in listed.schema)
    return listed, fixed and listed.count() <= FEW


def _split(df: DataFrame, keys: list[str], listed: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows that surely have no listed key, and those that may have one."""
    f = bloom(listed, listed.columns, most=most)
    attached = f.attach(df, *[F.col(f"`{k}`") for k in keys])
    hit = f.maybe(*[F.col(f"`{k}`") for k in keys])
    return f.detach(attached.where(~hit)), f.detach(attached.where(hit))


def without(df: DataFrame, keys: list[str], gone: DataFrame, most: int = MOST_BLOCKS) -> DataFrame:
    """Rows of df whose keys aren't among those of `gone`; null keys are equal to each other.

    Few keys are broadcast. Else df is read twice, and only rows that a Bloom filter of the keys lets pass meet
    them: wide rows whose keys stay aren't shuffled. Repeated rows stay or go together; without keys gone
    all rows stay. Columns keep their names.
    """
    gone, few = _listed(df, keys, gone)
    if few:
        return df.join(F.broadcast(gone), _same(keys), "left_anti")
    clear, unsure = _split(df, keys, gone, most)
    return clear.unionByName(unsure.join(gone, _same(keys), "left_anti"))


def only(df: DataFrame, keys: list[str], kept: DataFrame, most: int = MOST_BLOCKS) -> DataFrame:
    """Rows of df whose keys are among those of `kept`; few keys are broadcast, else rows that a Bloom filter rules out aren't shuffled."""
    kept, few = _listed(df, keys, kept)
    if few:
        return df.join(F.broadcast(kept), _same(keys), "left_semi")
    return _split(df, keys, kept, most)[1].join(kept, _same(keys), "left_semi")


def nearly_only(df: DataFrame, keys: list[str], kept: DataFrame, most: int = MOST_BLOCKS) -> DataFrame:
    """All rows whose keys are among those of `kept`, and a few others that a Bloom filter doesn't rule out. Nothing is shuffled."""
    kept, few = _listed(df, keys, kept)
    return df.join(F.broadcast(kept), _same(keys), "left_semi") if few else _split(df, keys, kept, most)[1]
