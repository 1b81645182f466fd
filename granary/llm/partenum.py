"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct word n-grams (as 64-bit hashes; fewer words are one gram). Two
sets link when 100 * |A and B| >= percent * |A or B|. The join is exact, in these steps:

1. Documents with equal sets form a class, named by a 128-bit fingerprint; a class is a node.
2. Sets are put into bands of similar size; a set also enters the lower bands in which a smaller
   partner may lie. Within a band linked sets differ in at most k features. The feature domain is
   split by hash into n1 parts, and each of these into n2 cells; so many parts that in any linked
   pair at least 1 + spare of them have at most `spoiled` differing features. Each subset of n2 -
   spoiled cells of each part gives one signature of the features in it: linked sets share one.
   A signature is poor if fewer than `few` of its features are uncommon, as texts with a passage in
   common share many of those. A set that has at most `spare` parts with a poor signature leaves
   these signatures out. Poorness depends on a signature's features alone, so it is the same in
   both sets of a pair, and one of their 1 + spare parts has no poor signature in either: they still
   share one. Which features are common is told by a table of fixed size in which the features of
   all rows are counted by hash; the pairs found don't depend on it, only the work does.
3. Signatures are dealt into buckets as packed arrays, and nodes that share one are joined to the
   least of them. The components of that candidate graph hold all links; no pairs are listed. Here
   a signature has 40 bits besides its bucket, and a node 40: what collides is taken for a candidate,
   and so are sets whose nodes collide with each other.
4. Candidates' sets are gathered by component, in blocks of a bounded number of features in the order of set sizes
   (in a large component each block meets the blocks of near sizes), and each task verifies its pairs exactly in numpy, rarest features
   first. It returns for each node its number of partners and a link to a local root.
5. Components over the verified links; a component's id is its least document id.

Texts are read twice in full, to describe them and to sign their sets, and a third time only one of
each class of candidates, which a filter of their places picks out of the files. When it signs, a task
remembers the sets that it has sent last, so a text with very many copies is sent about once a task.

Defined results: null text counts as empty; a document without words has an empty set, no links and
is its own component. Equal texts (also repeated rows, also with equal ids) are linked. Null ids
take part, but never name a component unless nothing else is in it (null then). Very long texts are
taken whole. Only id and text are read, so further columns can't clash; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.batches import give_back, tidy
from granary.llm.common import checkpointed, encoded, mix64, pieces
from granary.llm.components import components
from granary.llm.textscan import Scan
from granary.operators.dedup import located
from granary.operators.filters import nearly_only

_A, _B, _C, _D, _E = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F))
#: Bytes of text that are turned into numpy arrays at a time.
_PIECE = 1 << 20
#: Bytes of a signature or of a node's name in the candidate graph.
_WIDTH = 5
#: Cells of the table that counts features by hash (2**22 at one byte a task), in chunks of 2**14.
_CELLS, _CHUNK = 1 << 22, 1 << 14
#: A cell is common at 1.5 times the mean and one document in so many more.
_COMMON = 8192
#: Sets that a task remembers, in each of two generations.
_SEEN = 1 << 17
#: A class or node is heavy if it has more than one in so many of all rows, so at most so many are broadcast.
_HEAVY = 512


@dataclass(frozen=True)
class JoinSettings:
    words: int = 3
    percent: int = 90
    band_ratio: float = 1.3
    cells: int = 3  # second-level parts
    spoiled: int = 1  # of them left out in a signature
    spare: float = 0.0  # further first-level parts, as a share
    few: int = 0  # signatures over fewer uncommon features are left out where spare parts allow
    block: int = 1 << 20  # features of a block; a task compares two blocks at most
    bucket: int = 1 << 20  # signatures in one task
    node_bits: int = 40  # of a node's name in the candidate graph; results don't depend on them


def gram_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the texts' sets, and all features, text by text, ascending in each."""
    s = Scan(texts, lower=True)
    first, key = s.ngrams(n)
    doc = s.doc[first]
    short = np.flatnonzero((s.n_words > 0) & (s.n_words < n))
    if len(short):
        whole = np.concatenate([s.ngrams_of(s.word_at[d], s.n_words[d]) for d in short])
        doc, key = np.concatenate([doc, short]), np.concatenate([key, whole])
    order = np.argsort(key)
    by_doc = doc[order].astype(np.uint16) if len(texts) < 1 << 16 else doc[order]
    order = order[np.argsort(by_doc, kind="stable")]
    doc, key = doc[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[new], minlength=len(texts)), key[new], doc[new]


def fingerprints(sizes: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums for each set."""
    ends = np.cumsum(sizes)
    out = []
    for salt in (_A, _B):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(features ^ salt))])
        out.append(mix64(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64) * salt))
    return out[0], out[1]


class Bands:
    """Size bands with their numbers of first-level parts."""

    def __init__(self, settings: JoinSettings):
        self.percent = settings.percent
        low = [1]
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, int(np.ceil(low[-1] * settings.band_ratio))))
        self.low = np.array(low, np.int64)
        differing = (self.low[1:] - 1) * (100 - settings.percent) // settings.percent
        base = differing // (settings.spoiled + 1) + 1
        self.spare = np.ceil(base * settings.spare).astype(np.int64)
        #: 0 where only equal sets link
        self.parts = np.where(differing > 0, base + self.spare, 0)

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lowest band in which a partner may lie, and the own one."""
        least = -(-sizes * self.percent // 100)
        return np.searchsorted(self.low, least, "right") - 1, np.searchsorted(self.low, sizes, "right") - 1

    def signatures(self, sizes: np.ndarray, settings: JoinSettings) -> np.ndarray:
        """How many signatures a set has at most."""
        sums = np.concatenate([[0], np.cumsum(self.parts)])
        lowest, own = self.of(np.maximum(sizes, 1))
        return (sums[own + 1] - sums[lowest]) * len(list(combinations(range(settings.cells), settings.spoiled)))


def cells_of(features: np.ndarray) -> np.ndarray:
    """The cell of the counting table that each feature falls into."""
    return (features >> np.uint64(64 - _CELLS.bit_length() + 1)).astype(np.int64)


def signatures(sizes: np.ndarray, features: np.ndarray, bands: Bands, settings: JoinSettings, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Set number and signature, for all sets with features; `common` marks the cells of common features."""
    lowest, own = bands.of(np.maximum(sizes, 1))
    count = np.where(sizes > 0, own - lowest + 1, 0)
    which = np.repeat(np.arange(len(sizes)), count)  # one instance for each set and band
    if not len(which):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    band = lowest[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    some = bands.parts[band] > 0
    which, band = which[some], band[some]
    if not len(which):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    parts, n = bands.parts[band], sizes[which]
    starts = np.cumsum(sizes) - sizes
    feature = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[which], n)
    where, cell, value = mix64(features ^ _C), mix64(features ^ _D) % np.uint64(settings.cells), mix64(features ^ _E)
    per = np.repeat(parts, n).astype(np.uint64)
    part = (((where[feature] >> np.uint64(32)) * per) >> np.uint64(32)).astype(np.int64)
    base = np.cumsum(parts) - parts
    place = (np.repeat(base, n) + part) * settings.cells + cell[feature].astype(np.int64)
    rows = int(parts.sum())
    sums = np.zeros(rows * settings.cells, np.uint64)
    np.add.at(sums, place, value[feature])
    sums = sums.reshape(rows, settings.cells)
    instance = np.repeat(np.arange(len(parts)), parts)
    number = np.arange(rows) - base[instance]
    salt = mix64((band[instance].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64) * np.uint64(64))
    subsets = list(combinations(range(settings.cells), settings.cells - settings.spoiled))
    out = [mix64(sums[:, list(c)].sum(axis=1) ^ (salt + np.uint64(k))) for k, c in enumerate(subsets)]
    node = which[instance]
    if not settings.few:
        return np.tile(node, len(subsets)), np.concatenate(out)
    uncommon = None if common is None else ~common[cells_of(features)][feature]
    held = np.bincount(place, uncommon, minlength=rows * settings.cells).reshape(rows, settings.cells)
    poor = [held[:, list(c)].sum(axis=1) < settings.few for c in subsets]
    poor_parts = np.bincount(instance[np.any(poor, axis=0)], minlength=len(parts))
    forced = (poor_parts > bands.spare[band])[instance]
    keep = [~x | forced for x in poor]
    return np.concatenate([node[x] for x in keep]), np.concatenate([s[x] for s, x in zip(out, keep, strict=True)])


def verified(sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs of the sets (distinct features each); with sides, only pairs across them."""
    n = np.array([len(s) for s in sets], np.int64)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    owner = np.repeat(np.arange(len(sets)), n)
    token = rank[token]
    order = np.lexsort((token, owner))
    token = token[order]  # by set, rarest first
    end = np.cumsum(n)
    start = end - n
    prefix = n - (-(-n * percent // 100)) + 1
    at = np.arange(len(token)) - np.repeat(start, n)
    lead = np.flatnonzero(at < np.repeat(prefix, n))
    by_token = lead[np.argsort(token[lead], kind="stable")]
    posting_token, posting_node = token[by_token], owner[by_token]  # owner is in set order, as token is
    low = np.searchsorted(posting_token, np.arange(len(count) + 1))
    mark = np.zeros(len(count), bool)
    left, right = [], []
    for x in range(len(sets)):
        own = token[start[x] : start[x] + prefix[x]]
        found = np.concatenate([posting_node[low[t] : low[t + 1]] for t in own]) if len(own) else np.zeros(0, np.int64)
        found = np.unique(found[found > x])
        found = found[(100 * np.minimum(n[found], n[x]) >= percent * np.maximum(n[found], n[x]))]
        if side is not None:
            found = found[side[found] != side[x]]
        if not len(found):
            continue
        mark[token[start[x] : end[x]]] = True
        step = max(1, (1 << 18) // int(n[found].max()))  # sets looked up at a time
        for k in range(0, len(found), step):
            some = found[k : k + step]
            m = n[some]
            ends = np.cumsum(m)
            inner = np.arange(ends[-1]) + np.repeat(start[some] - (ends - m), m)
            common = np.add.reduceat(mark[token[inner]], ends - m, dtype=np.int64)
            hit = some[100 * common >= percent * (n[x] + m - common)]
            left.append(np.full(len(hit), x))
            right.append(hit)
        mark[token[start[x] : end[x]]] = False
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A representative of each local component."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)])


class Seen:
    """Tells which sets are new to a task: the last ones are remembered, in two generations of bounded size."""

    def __init__(self):
        self.young: set[tuple[int, int]] = set()
        self.old: set[tuple[int, int]] = set()

    def new(self, a: np.ndarray, b: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Of the wanted sets, those that weren't seen before, as a mask."""
        out = np.zeros(len(a), bool)
        for i in np.flatnonzero(wanted).tolist():
            key = (int(a[i]), int(b[i]))
            if key in self.young:
                continue
            out[i] = key not in self.old
            if len(self.young) >= _SEEN:
                self.old, self.young = self.young, set()
            self.young.add(key)
        return out


def _narrow(x: np.ndarray) -> bytes:
    """The low bytes of each number."""
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :_WIDTH].tobytes()


def _wide(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, _WIDTH)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :_WIDTH] = raw
    return out.view("<u8")[:, 0]


def _packed_cells(counts: np.ndarray) -> bytes:
    """Counts of one chunk, up to 255: all of them, or the places and counts of those above 0, whichever is shorter."""
    some = np.flatnonzero(counts)
    if 3 * len(some) >= _CHUNK:
        return np.minimum(counts, 255).astype(np.uint8).tobytes()
    return some.astype("<u2").tobytes() + np.minimum(counts[some], 255).astype(np.uint8).tobytes()


def _add_cells(total: np.ndarray, packed: bytes) -> None:
    if len(packed) == _CHUNK:
        total += np.frombuffer(packed, np.uint8)
    else:
        n = len(packed) // 3
        total[np.frombuffer(packed, "<u2", n)] += np.frombuffer(packed, np.uint8, n, 2 * n)


def _common_cells(sketches: DataFrame, mean: float, documents: int) -> np.ndarray:
    """The cells of the counting table that hold common features, from all tasks' counts (chunk, part, cells)."""
    least = 1.5 * mean + max(8, documents / _COMMON)

    def merge(group: pa.Table) -> pa.Table:
        total = np.zeros(_CHUNK, np.int64)
        for packed in group["cells"]:
            _add_cells(total, packed.as_py())
        return pa.table({"chunk": group["chunk"][:1], "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    def finish(group: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(x.as_py(), "<i8") for x in group["counts"]), np.zeros(_CHUNK, np.int64))
        return pa.table({"chunk": group["chunk"][:1], "common": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})

    merged = sketches.withColumn("some", F.floor(F.col("part") / 256)).groupBy("chunk", "some").applyInArrow(merge, "chunk long, counts binary")
    rows = merged.groupBy("chunk").applyInArrow(finish, "chunk long, common binary").collect()
    out = np.zeros(_CELLS, bool)
    for r in rows:
        out[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.unpackbits(np.frombuffer(r["common"], np.uint8)).astype(bool)
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _node(a: str = "a", b: str = "b"):
    return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: JoinSettings = JoinSettings(), from_files: bool = False) -> DataFrame:
    """One row for each row of df: id, n_shingles, component_id, n_links (other rows that it links with).

    `from_files` says that df is read from Parquet files with no more than filters and projections, so that
    rows can be named by their places; otherwise ids and texts are checkpointed once.
    """
    bands, node_mask = Bands(settings), (1 << settings.node_bits) - 1
    source = located(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), from_files)
    kind = source.schema["id"].dataType.simpleString()
    texts = source.select("text")
    names = ["id", "n", "signatures", "a", "b", "file", "row", "chunk", "part", "cells"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Size and fingerprint of each row's set; at the end the task's counts of features by cell."""
        id_type, counts = None, np.zeros(_CELLS, np.uint32)
        for piece in pieces(batches, "text", _PIECE):
            id_type = piece.schema.field("id").type
            sizes, features, _ = gram_sets(encoded(piece.column("text")), settings.words)
            a, b = fingerprints(sizes, features)
            if settings.few:
                np.add.at(counts, cells_of(features), np.uint32(1))
            per_row = np.where(sizes > 0, bands.signatures(sizes, settings), 0)
            none = [pa.nulls(len(sizes), t) for t in (pa.int64(), pa.int64(), pa.binary())]
            places = [piece.column("__file"), piece.column("__row")]
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(sizes, pa.int64()), pa.array(per_row, pa.int64()), _signed(a), _signed(b), *places, *none], names=names)
        held = np.flatnonzero(counts.reshape(-1, _CHUNK).any(axis=1))
        if id_type is not None and len(held):
            cells = pa.array([_packed_cells(counts[k * _CHUNK : (k + 1) * _CHUNK]) for k in held.tolist()], pa.binary())
            part = pa.array([TaskContext.get().partitionId()] * len(held), pa.int64())
            none = [pa.nulls(len(held), t) for t in (id_type, *[pa.int64()] * 6)]
            yield pa.RecordBatch.from_arrays([*none, pa.array(held, pa.int64()), part, cells], names=names)

    described = checkpointed(source.mapInArrow(tidy(describe), f"id {kind}, n long, signatures long, a long, b long, file long, row long, chunk long, part long, cells binary"))
    docs = described.where("chunk IS NULL").select("id", "n", "signatures", "a", "b", "file", "row")
    total, occurrences, documents = docs.agg(F.coalesce(F.sum("signatures"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(1, -(-total // settings.bucket))
    common = _common_cells(described.where("chunk IS NOT NULL"), occurrences / _CELLS, documents) if settings.few else None
    common = None if common is None else np.packbits(common)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, table = Seen(), None if common is None else np.unpackbits(common).astype(bool)
        for piece in pieces(batches, "text", _PIECE):
            sizes, features, _ = gram_sets(encoded(piece.column("text")), settings.words)
            a, b = fingerprints(sizes, features)
            once = seen.new(a, b, sizes > 0)
            features, sizes, a = features[np.repeat(once, sizes)], sizes[once], a[once]
            node, signature = signatures(sizes, features, bands, settings, table)
            bucket = ((signature >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
            # the low bytes: the bucket comes from the high ones
            node, signature, bucket = a[node[order]] & np.uint64(node_mask), signature[order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket)) + 1
            bounds = list(zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)], strict=True)) if len(bucket) else []
            columns = [[int(bucket[lo]) for lo, _ in bounds], *([_narrow(x[lo:hi]) for lo, hi in bounds] for x in (signature, node))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "signatures", "nodes"])

    def meet(group: pa.Table) -> pa.Table:
        signature, node = _wide(group["signatures"].to_pylist()), _wide(group["nodes"].to_pylist())
        order = np.argsort(signature, kind="stable")
        signature, node = signature[order], node[order]
        head = np.ones(len(signature), bool)
        head[1:] = signature[1:] != signature[:-1]
        first = np.flatnonzero(head)
        least = np.minimum.reduceat(node, first)[np.cumsum(head) - 1] if len(node) else node
        other = least != node
        pairs = np.unique(np.stack([least[other], node[other]], axis=1), axis=0).view(np.int64)
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    near = texts.mapInArrow(tidy(sign), "bucket long, signatures binary, nodes binary").groupBy("bucket").applyInArrow(meet, "u long, v long")
    classes = docs.where("n > 0").groupBy("a", "b").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.first("file").alias("file"), F.first("row").alias("row"))
    classes = checkpointed(classes.withColumn("node", F.col("a").bitwiseAND(F.lit(node_mask))))
    crowded = classes.groupBy("node").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("node", F.col("node").alias("component"))
    found = components(near)
    candidates = checkpointed(found.unionByName(crowded.join(found, "node", "left_anti")))
    del near, found

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", _PIECE):
            sizes, features, _ = gram_sets(encoded(piece.column("text")), settings.words)
            ends = np.cumsum(sizes)
            blobs = pa.array([features[end - size : end].tobytes() for end, size in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column("__file"), piece.column("__row"), blobs], names=["file", "row", "features"])

    # a component's nodes are put into blocks in the order of their sizes, those of one size by hash;
    # only blocks whose sizes are near enough for a link meet
    placed = classes.join(candidates, "node")
    by_size = W.partitionBy("component").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy("component", "n").agg(F.count(F.lit(1)).alias("same")).withColumn("before", F.coalesce(F.sum(F.col("same") * F.col("n")).over(by_size), F.lit(0)))
    sizes = sizes.select(F.col("component").alias("size_component"), F.col("n").alias("size_n"), "same", "before")
    placed = placed.join(sizes, (F.col("component") == F.col("size_component")) & (F.col("n") == F.col("size_n")))
    placed = placed.withColumn("own", F.floor((F.col("before") + F.pmod(F.xxhash64("a", "b"), F.col("same")) * F.col("n")) / settings.block))
    placed = checkpointed(placed.select("component", "a", "b", "copies", "n", "own", "file", "row"))
    blocks = placed.groupBy("component", "own").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    lower, upper = blocks.select("component", F.col("own").alias("i"), "high"), blocks.select("component", F.col("own").alias("j"), "low")
    meeting = lower.join(upper, "component").where((F.col("i") <= F.col("j")) & (settings.percent * F.col("low") <= 100 * F.col("high"))).select("component", "i", "j")
    sides = meeting.withColumn("own", F.explode(F.array_distinct(F.array("i", "j"))))
    tasks = max(1, -(-placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // settings.block))
    placed = placed.join(sides, ["component", "own"]).select(
        F.when((F.col("i") == 0) & (F.col("j") == 0), F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(F.xxhash64("component", "i", "j")).alias("task"),
        F.xxhash64("component", "i", "j").alias("part"), (F.col("i") == F.col("j")).alias("inner"), "own", "copies", "a", "b", "file", "row",
    )
    wanted = source.select("text", "__file", "__row")
    wanted = nearly_only(wanted, ["__file", "__row"], placed.select(F.col("file").alias("__file"), F.col("row").alias("__row")))
    sets = wanted.mapInArrow(tidy(bring), "file long, row long, features binary")
    placed = sets.join(placed, ["file", "row"]).select("task", "part", "inner", "own", "copies", "a", "b", "features")

    def compare(group: pa.Table) -> pa.Table:
        rows = group.select(["part", "inner", "own", "copies", "a", "b"]).to_pandas()
        blobs = group["features"]
        out = []
        for _, at in sorted(rows.groupby("part").indices.items()):
            sets_here = [np.frombuffer(blobs[int(i)].as_py(), np.uint64) for i in at]
            inner = bool(rows["inner"].iloc[at[0]])
            left, right = verified(sets_here, None if inner else rows["own"].to_numpy()[at], settings.percent)
            if len(left):
                root, copies = _roots(len(at), left, right), rows["copies"].to_numpy()[at]
                links = np.bincount(left, copies[right], len(at)) + np.bincount(right, copies[left], len(at))
                a, b = rows["a"].to_numpy()[at], rows["b"].to_numpy()[at]
                hit = links > 0
                out.append(pd.DataFrame({"a": a[hit], "b": b[hit], "c": a[root][hit], "d": b[root][hit], "links": links[hit].astype(np.int64)}))
        frame = pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("a", "b", "c", "d", "links")})
        del out, rows, blobs
        give_back()
        return pa.Table.from_pandas(frame, preserve_index=False)

    # a block against another one holds each node of both once; a block of its own is compared in its own task
    found = checkpointed(placed.groupBy("task").applyInArrow(compare, "a long, b long, c long, d long, links long"))
    del placed, sets
    links = found.groupBy("a", "b").agg(F.sum("links").alias("links"))
    linked = components(found.select(_node().alias("u"), _node("c", "d").alias("v"))).select("node.a", "node.b", "component")
    named = classes.join(linked, ["a", "b"], "left").join(links, ["a", "b"], "left")
    least = classes.join(linked, ["a", "b"]).groupBy("component").agg(F.min("least").alias("low"))
    named = checkpointed(named.join(least, "component", "left").select("a", "b", "copies", F.coalesce("low", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    joined = _by_class(docs.where("n > 0"), named, documents).select("id", "n", "component_id", "n_links")
    empty = docs.where("n = 0").select("id", "n", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return joined.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links")


def _by_class(docs: DataFrame, named: DataFrame, documents: int) -> DataFrame:
    """Rows with what is known of their class. The few classes with very many rows are broadcast, so none of them is one task's."""
    large = F.col("copies") > max(1_000, documents // _HEAVY)
    heavy = F.broadcast(named.where(large))
    return docs.join(heavy, ["a", "b"]).unionByName(docs.join(heavy.select("a", "b"), ["a", "b"], "left_anti").join(named.where(~large), ["a", "b"]))
