"""Exact duplicates by content hash, near duplicates by MinHash bands with greedy resolution, semi-joins."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.batches import PIECE_BYTES, spans, text_bytes, tidy
from granary.functions.text import words
from granary.operators import filters
from granary.plans.session import materialized

# Fixed values of the sketch: 128 permutations, 8 bands of 16 rows (threshold 0.85), modulus 2**31 - 1.
PERMUTATIONS, BANDS, MODULUS = 128, 8, (1 << 31) - 1
#: Hashes permuted at a time.
_RUN = 512


def permutations(seed: int = 1) -> tuple[list[int], list[int]]:
    """Factors and shifts of the hash family (a * h + b) mod MODULUS."""
    draw = random.Random(seed)
    return [draw.randrange(1, MODULUS) for _ in range(PERMUTATIONS)], [draw.randrange(0, MODULUS) for _ in range(PERMUTATIONS)]


def located(df: DataFrame, from_files: bool) -> DataFrame:
    """Adds __file and __row, a name for each row that a second read gives again.

    For rows `from_files`, read from Parquet files with no more than filters and projections, it is where the row stands; all
    others are written to the checkpoint folder once, unshuffled, and named there.
    """
    if from_files:
        return df.select("*", F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return materialized(df.select("*", F.lit(0).cast("long").alias("__file"), F.monotonically_increasing_id().alias("__row")))


def exact_dedup(df: DataFrame, content: Column, order: list[Column], from_files: bool = False) -> DataFrame:
    """Of rows with equal content hash the first in the order stays, and only that one.

    What is aggregated (map-side first, so a hash with very many rows is no hot spot) and sorted are
    the hashes, order keys and places of rows, never whole rows. The places of the rows that go then
    meet the rows by a Bloom filter, so rows that stay aren't shuffled. Rows of different hashes may
    share an order key. Of rows with one hash and one order key the first by its place stays;
    repeated rows give one. Null is a hash of its own. Without rows the result is empty. Columns keep
    their names, whatever they are. `from_files`: see located.
    """
    rows = located(df, from_files)
    at = [o.alias(f"o{k}") for k, o in enumerate(order)]
    keyed = materialized(rows.select(content.alias("hash"), F.struct(*at, "__file", "__row").alias("at")))
    shared = keyed.groupBy("hash").agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("hash").alias("same"), "least")
    later = keyed.join(shared, F.col("hash").eqNullSafe(F.col("same"))).where(F.col("at") != F.col("least"))
    return filters.without(rows, ["__file", "__row"], later.select("at.__file", "at.__row")).select(*[F.col(f"`{c}`") for c in df.columns])


def word_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words): distinct words in order; null and blank texts have none."""
    return df.select(id_col, F.array_sort(F.array_distinct(words(F.col(text_col)))).alias("words"))


def word_hashes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hashes): hash of each distinct word, in SQL functions."""
    hashed = F.transform(F.array_distinct(words(F.col(text_col))), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % MODULUS)
    return df.select(id_col, F.array_sort(F.array_distinct(hashed)).alias("hashes"))


def signatures(sets: DataFrame, id_col: str = "doc_id", seed: int = 1) -> DataFrame:
    """(id, signature): the least permuted hash for each permutation, in numpy over Arrow batches.

    An empty set has MODULUS everywhere, as has a null one. Rows stay as they are: repeated and null ids have a signature each.
    """
    a, b = (np.array(x, np.uint64) for x in permutations(seed))
    kept = [c for c in sets.columns if c != "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column("hashes")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in spans(8 * (lengths + PERMUTATIONS), PIECE_BYTES):
                part, sizes = batch.slice(lo, hi - lo), lengths[lo:hi]
                least = _least(part.column("hashes").flatten().to_numpy(zero_copy_only=False).astype(np.uint64), sizes, a, b)
                offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * len(a))
                signed = pa.ListArray.from_arrays(offsets, pa.array(least.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), signed], names=[*kept, "signature"])

    source = sets.select(*kept, "hashes")
    return source.mapInArrow(tidy(run), "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in kept) + "signature array<long>")


def _least(h: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(sets, permutations): the least permuted hash of each set.

    Hashes are taken in runs that fit a processor's cache; MODULUS is 2**31 - 1, so a remainder is a
    sum of the high and the low bits, taken twice.
    """
    out = np.full((len(sizes), len(a)), MODULUS, np.int64)
    ends = np.cumsum(sizes)
    some = np.flatnonzero(sizes)
    low, shift = np.uint64(MODULUS), np.uint64(31)
    for lo in range(0, len(h), _RUN):
        hi = min(len(h), lo + _RUN)
        rows = some[np.searchsorted(ends[some], lo, "right") : np.searchsorted(ends[some] - sizes[some], hi, "left")]
        at = np.maximum(ends[rows] - sizes[rows] - lo, 0)
        x = a[:, None] * h[None, lo:hi]
        x += b[:, None]
        for _ in range(2):
            high = x >> shift
            x &= low
            x += high
        np.minimum(x, np.subtract(x, low, out=high), out=x)  # what is less than MODULUS wraps around and stays
        out[rows] = np.minimum(out[rows], np.minimum.reduceat(x, at, axis=1).T.astype(np.int64))
    return out


def bands(signed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, band, key): a hash of each band's rows, for each row; a null signature has null keys, which meet nothing."""
    return signed.select(id_col, F.posexplode(_band_keys()).alias("band", "key"))


def _band_keys() -> Column:
    rows = PERMUTATIONS // BANDS
    return F.array(*[F.md5(F.array_join(F.slice("signature", 1 + k * rows, rows).cast("array<string>"), ",")) for k in range(BANDS)])


def near_pairs(banded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(low, high): distinct pairs that share a band. It lists every pair of a bucket, so give it one id of each distinct
    word set; near_dedup decides without listing any. Null ids are in no pair, nor is an id with itself."""
    left, right = banded.select(F.col(id_col).alias("low"), "band", "key"), banded.select(F.col(id_col).alias("high"), "band", "key")
    return left.join(right, ["band", "key"]).where("low < high").select("low", "high").distinct()


def resolve_greedily(nodes: DataFrame, pairs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Kept ids: what a loop in ascending order keeps that drops whatever is near something kept before.

    In each round a node is kept when all its lower neighbours are dropped, and dropped when one is
    kept; rounds end when none is undecided. Only linked nodes take part.
    """
    pairs = materialized(pairs)
    linked = pairs.select(F.col("low").alias("id")).union(pairs.select(F.col("high").alias("id"))).distinct()
    states = materialized(linked.withColumn("state", F.lit("U")))
    while not states.where("state = 'U'").isEmpty():
        around = pairs.join(states.select(F.col("id").alias("low"), F.col("state").alias("lower")), "low").groupBy(F.col("high").alias("id"))
        around = around.agg(F.max(F.col("lower") == "K").alias("hit"), F.min(F.col("lower") == "D").alias("free"))
        decided = F.when(F.col("state") != "U", F.col("state")).when(F.col("hit"), "D").when(F.coalesce("free", F.lit(True)), "K").otherwise("U")
        states = materialized(states.join(around, "id", "left").select("id", decided.alias("state")))
    dropped = states.where("state = 'D'").select(F.col("id").alias(id_col))
    return nodes.select(id_col).join(dropped, id_col, "left_anti")


def resolve_buckets(banded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Dropped ids: what resolve_greedily drops when all members of a band's bucket are near each other.

    No pairs are listed. Of each bucket two numbers are aggregated (map-side first): its least
    member that isn't dropped, and its least kept one. A member that is the least in all its buckets
    is kept; one that has a lower kept one in any bucket is dropped.
    """
    shared = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "key")
    members = materialized(banded.join(shared, ["band", "key"], "left_semi").select(F.col(id_col).alias("id"), "band", "key"))
    states = materialized(members.select("id").distinct().withColumn("state", F.lit("U")))
    while not states.where("state = 'U'").isEmpty():
        standing = F.min(F.when(F.col("state") != "D", F.col("id"))).alias("standing")
        kept = F.min(F.when(F.col("state") == "K", F.col("id"))).alias("kept")
        lows = members.join(states, "id").groupBy("band", "key").agg(standing, kept)
        around = members.join(lows, ["band", "key"]).groupBy("id").agg(F.max(F.coalesce(F.col("kept") < F.col("id"), F.lit(False))).alias("hit"), F.min(F.coalesce(F.col("standing") == F.col("id"), F.lit(True))).alias("free"))
        decided = F.when(F.col("state") != "U", F.col("state")).when(F.col("hit"), "D").when(F.col("free"), "K").otherwise("U")
        states = materialized(states.join(around, "id").select("id", decided.alias("state")))
    return states.where("state = 'D'").select(F.col("id").alias(id_col))


class WordHashes(dict):
    """Hashes of words as word_hashes has them; the usual ones are remembered, in two generations of `limit` words each."""

    def __init__(self, limit: int = 1 << 16):
        super().__init__()
        self.limit, self.old = limit, {}

    def __missing__(self, word: str) -> int:
        value = self.old.get(word)
        if value is None:
            value = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % MODULUS
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the text's words."""
        return np.unique(np.array([self[w] for w in set((text or "").split())], np.uint64))


def signature_store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """(id, digest, signature): what near-duplicate resolution needs of each row, a bounded number of bytes. The digest is the
    word set's; rows can be written with sinks.write_parquet, read again and unioned with those of later documents.

    Equals signatures(word_hashes(df)), in one pass over Arrow batches.
    """
    a, b = (np.array(x, np.uint64) for x in permutations(seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for lo, hi in spans(text_bytes(batch.column("text")) + 8 * PERMUTATIONS, PIECE_BYTES):
                part = batch.slice(lo, hi - lo)
                sets = [hashes.of(t.as_py()) for t in part.column("text")]
                sizes = np.array([len(x) for x in sets], np.int64)
                least = _least(np.concatenate(sets), sizes, a, b)
                digests = pa.array([hashlib.md5(x.tobytes()).hexdigest() for x in sets], pa.string())
                offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * len(a))
                yield pa.RecordBatch.from_arrays([part.column("id"), digests, pa.ListArray.from_arrays(offsets, pa.array(least.reshape(-1)))], names=["id", "digest", "signature"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = source.mapInArrow(tidy(run), f"id {source.schema['id'].dataType.simpleString()}, digest string, signature array<long>")
    return signed.withColumnRenamed("id", id_col)


def near_dedup_stored(store: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Kept ids of the documents in a signature store. Equal word sets fall together first, which is exact (their sketches are
    equal) and takes copies and blank texts out of the bands. A null id stands for a word set only where no other does."""
    least = F.min(F.struct(F.col(id_col).isNull().alias("unnamed"), id_col, "signature")).alias("least")
    firsts = materialized(store.groupBy("digest").agg(least).select(f"least.{id_col}", "least.signature"))
    dropped = resolve_buckets(bands(firsts, id_col), id_col)
    return firsts.select(id_col).distinct().join(dropped, id_col, "left_anti")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """Kept ids, each once.

    A null text counts as blank; blank texts are equal to each other. Repeated rows and copies give
    their least id that isn't null. Several texts under one id are one document with all their signatures.
    Null ids aren't resolved against others and appear once, if any text has no other id; near_dedup_rows
    resolves such rows, too. Only id and text are read, so further columns can't clash; an empty
    table gives an empty result.
    """
    return near_dedup_stored(materialized(signature_store(df, id_col, text_col, seed)), id_col)


def near_dedup_rows(df: DataFrame, text_col: str = "text", seed: int = 1, from_files: bool = False) -> DataFrame:
    """The rows of df that near-duplicate resolution keeps, each row being a document of its own, whatever its id.

    Rows are taken in the order of their places. Columns keep their names. `from_files`: see located.
    """
    rows = located(df, from_files)
    place = F.struct("__file", "__row").alias("__id")
    kept = near_dedup_stored(materialized(signature_store(rows.select(place, F.col(f"`{text_col}`").alias("text")), "__id", "text", seed)), "__id")
    return filters.only(rows, ["__file", "__row"], kept.select("__id.__file", "__id.__row")).select(*[F.col(f"`{c}`") for c in df.columns])


def semi_join(df: DataFrame, kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose id is kept; a kept null keeps the rows without an id, so no text is lost with its id. Spark broadcasts
    the ids only if their size is known to be small."""
    kept = kept.select(F.col(id_col).alias("__kept"))
    return df.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col("__kept")), "left_semi")
