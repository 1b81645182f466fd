"""Near duplicates by SimHash, joined with themselves over a binary trie.

A document's fingerprint has 64 bits; each is the majority of that bit in the XXH64 hashes of its
word shingles, repeats included (fewer words: the whole sequence; none: zero). Fingerprints that
differ in few bits link, and a component is what links connect.

1. Equal fingerprints fall together first, each task's own before any shuffle.
2. The trie over all fingerprints is cut into subtrees of bounded size. What the driver gets for
   that is counts by prefix, no fingerprints. A pair of subtrees whose prefixes differ in more bits
   than allowed is pruned; every other pair is a task that holds two subtrees.
3. A task walks its two subtries from the root together, a level at a time: each pair of nodes goes
   on to the pairs of their children, which differ in one bit more where the children's bits differ,
   and is dropped beyond the budget. Nodes are ranges of a sorted array. A pair of nodes with few
   fingerprints is compared directly. Long lists of node pairs are halved and walked one after the
   other, so memory is bounded.
4. Links are found in pieces and merged into local trees at once; a task returns one link for each
   linked fingerprint at most. Components are then built over all tasks' links.

Defined results: null text counts as empty; all documents without words have fingerprint zero and are
linked like any others. Repeated rows are rows of their own. Null ids take part, but name a component
only if nothing else is in it (null then). Very long texts are taken whole. Only id and text are read,
so further columns can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import checkpointed, encoded, pieces
from granary.llm.components import components

_BITS = 64
#: Prefix bits of the first counts, and of each further one, below subtrees that are too large.
_FIRST, _MORE = 12, 4
#: Shingles that are hashed at a time.
_RUN = 1 << 16
#: Node pairs of one level that are held at a time.
_WIDE = 1 << 18
#: A pair of nodes with so many pairs of fingerprints is compared directly.
_DIRECT = 16
#: Fingerprints that a task gathers before it deals them to pairs of subtrees.
_HELD = 1 << 20
#: A fingerprint is heavy if it has more than one in so many of all rows, so at most so many are broadcast.
_HEAVY = 512


@dataclass(frozen=True)
class SimHashSettings:
    words: int = 4  # of a shingle
    seed: int = 42  # of XXH64
    differing: int = 4  # bits at most
    subtree: int = 1 << 17  # fingerprints at most
    subtrees: int = 12  # at least so many, where there are fingerprints enough


def fingerprint(text: bytes, settings: SimHashSettings = SimHashSettings()) -> int:
    import xxhash

    words, n = text.lower().split(), settings.words  # of bytes: A to Z only, ASCII white space only
    if not words:
        return 0
    joined, last = b" ".join(words), max(1, len(words) - n + 1)
    start = np.cumsum([0, *(len(w) + 1 for w in words)])
    begin, end = start[:last].tolist(), (start[n:] - 1).tolist() if len(words) > n else [len(joined)]
    of, seed, ones = xxhash.xxh64_intdigest, settings.seed, np.zeros(_BITS, np.int64)
    for k in range(0, last, _RUN):
        hashes = np.array([of(joined[b:e], seed) for b, e in zip(begin[k : k + _RUN], end[k : k + _RUN], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: SimHashSettings = SimHashSettings()) -> DataFrame:
    """(id, bits): one row for each row of df; bits is a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            bits = np.array([fingerprint(t, settings) for t in encoded(piece.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(bits.view(np.int64))], names=["id", "bits"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, bits long")


class Walk:
    """Walks the tries over two sorted arrays of distinct fingerprints together; the second may be the first one."""

    def __init__(self, x: np.ndarray, y: np.ndarray | None, budget: int):
        self.itself = y is None
        self.x, self.y, self.budget = x, x if y is None else y, budget
        self.ones: dict[tuple[int, int], np.ndarray] = {}

    def _middle(self, side: int, depth: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the children with the bit begin, of nodes [low, high) of one depth."""
        key = (0 if self.itself else side, depth)
        if key not in self.ones:
            bit = (self.y if side else self.x) >> np.uint64(_BITS - 1 - depth) & np.uint64(1)
            self.ones[key] = np.concatenate([np.zeros(1, np.int32), np.cumsum(bit.astype(np.int32), dtype=np.int32)])
        ones = self.ones[key]
        return high - (ones[high] - ones[low])

    def _compared(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = nodes[1] - nodes[0], nodes[3] - nodes[2]
        n = a * b
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        b = np.repeat(b, n)
        i, j = np.repeat(nodes[0], n) + at // b, np.repeat(nodes[2], n) + at % b
        near = np.bitwise_count(self.x[i] ^ self.y[j]) <= self.budget
        if self.itself:
            near &= i < j
        return i[near], j[near]

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of linked pairs, each pair once, in pieces."""
        todo = [(0, np.array([[0], [len(self.x)], [0], [len(self.y)], [0]], np.int64))] if len(self.x) and len(self.y) else []
        while todo:
            depth, nodes = todo.pop()
            few = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2]) <= _DIRECT
            if few.any():
                yield self._compared(nodes[:, few])
                nodes = nodes[:, ~few]
            if not nodes.shape[1]:
                continue
            low_a, high_a, low_b, high_b, errors = nodes
            mid_a, mid_b = self._middle(0, depth, low_a, high_a), self._middle(1, depth, low_b, high_b)
            children = [(low_a, mid_a, low_b, mid_b, errors), (mid_a, high_a, mid_b, high_b, errors), (low_a, mid_a, mid_b, high_b, errors + 1), (mid_a, high_a, low_b, mid_b, errors + 1)]
            out = []
            for k, child in enumerate(children):
                child = np.stack(child)
                keep = (child[0] < child[1]) & (child[2] < child[3]) & (child[4] <= self.budget)
                if self.itself and k == 3:
                    keep &= child[0] < child[2]  # of a node with itself the other order is there already
                out.append(child[:, keep])
            nodes = np.concatenate(out, axis=1)
            parts = -(-nodes.shape[1] // _WIDE)
            todo += [(depth + 1, part) for part in np.array_split(nodes, parts, axis=1)] if parts else []


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after the links i-j; each element's root is the least it is connected with so far."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def subtrees(bits: DataFrame, total: int, settings: SimHashSettings) -> tuple[np.ndarray, np.ndarray]:
    """First fingerprint and depth of the subtrees that the trie is cut into, in order."""
    most = max(1, min(settings.subtree, total // settings.subtrees))
    found: list[tuple[int, int]] = []
    large, depth = [0], 0
    while large:
        further = min(_BITS, depth + (_MORE if depth else _FIRST))
        rows = bits
        if depth:
            at = bits.sparkSession.createDataFrame([(p,) for p in large], "large long")  # at most one for every `most` rows
            rows = bits.join(at, F.shiftrightunsigned("bits", _BITS - depth) == F.col("large"), "left_semi")
        counted = rows.groupBy(F.shiftrightunsigned("bits", _BITS - further).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).collect()
        held = {int(r["prefix"]) % (1 << _BITS): int(r["n"]) for r in counted}
        # prefixes of one parent that fit together are one subtree
        sums: dict[tuple[int, int], int] = {}
        for prefix, n in held.items():
            for d in range(further, depth - 1, -1):
                key = (d, prefix >> (further - d))
                sums[key] = sums.get(key, 0) + n
        fits = lambda d, p: sums.get((d, p), 0) <= most or d == _BITS
        for d, p in sums:
            if fits(d, p) and (d == 0 or not (d > depth and fits(d - 1, p >> 1))):
                found.append((p << (_BITS - d), d))
        large, depth = [p for p in held if not fits(further, p)], further
    found.sort()
    return np.array([p for p, _ in found], np.uint64), np.array([d for _, d in found], np.int64)


def links(bits: DataFrame, settings: SimHashSettings = SimHashSettings()) -> DataFrame:
    """(u, v): links between distinct fingerprints (bits), enough of them to connect what is linked."""
    first, depths = subtrees(bits, bits.count(), settings)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            values = np.sort(np.concatenate(held))
            at = np.searchsorted(first, values, "right") - 1
            edges = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = int(at[lo])
                common = np.minimum(depths, depths[own])
                differing = np.bitwise_count(np.where(common > 0, (first ^ first[own]) >> np.minimum(_BITS - common, _BITS - 1).astype(np.uint64), 0))
                partners = np.flatnonzero(differing <= settings.differing)
                n = len(partners)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(partners, own)), pa.array(np.maximum(partners, own)), pa.array(np.full(n, own)), pa.array([values[lo:hi].tobytes()] * n, pa.binary())], names=["i", "j", "own", "held"]
                )

        held: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column("bits").to_numpy().view(np.uint64))
            if sum(map(len, held)) >= _HELD:
                yield from dealt(held)
                held = []
        if held:
            yield from dealt(held)

    def walk(group: pa.Table) -> pa.Table:
        i, own = group["i"][0].as_py(), group["own"].to_numpy()
        itself = i == group["j"][0].as_py()
        side = lambda mine: np.sort(np.frombuffer(b"".join(x.as_py() for x, m in zip(group["held"], mine, strict=True) if m), np.uint64))
        x, y = side(own == i), None if itself else side(own != i)
        values = x if itself else np.concatenate([x, y])
        root = np.arange(len(values))
        for a, b in Walk(x, y, settings.differing).links():
            root = merge(root, a, b if itself else b + len(x))
        linked = np.flatnonzero(root != np.arange(len(values)))
        return pa.table({"u": pa.array(values[linked].view(np.int64)), "v": pa.array(values[root[linked]].view(np.int64))})

    if not len(first):
        return bits.select(F.col("bits").alias("u"), F.col("bits").alias("v"))
    return bits.select("bits").mapInArrow(deal, "i long, j long, own long, held binary").groupBy("i", "j").applyInArrow(walk, "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: SimHashSettings = SimHashSettings()) -> DataFrame:
    """One row for each row of df: id, fingerprint (16 hexadecimal digits), component_id."""
    docs = checkpointed(fingerprints(df, id_col, text_col, settings))
    classes = checkpointed(docs.groupBy("bits").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")))
    linked = components(links(classes.select("bits"), settings)).select(F.col("node").alias("bits"), "component")
    known = checkpointed(classes.join(linked, "bits", "left"))
    lows = known.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("low"))
    named = checkpointed(known.join(lows, "component", "left").select("bits", "copies", F.coalesce("low", "least").alias("component_id")))
    documents = docs.count()
    large = F.col("copies") > max(1_000, documents // _HEAVY)
    heavy = F.broadcast(named.where(large))
    joined = docs.join(heavy, "bits").unionByName(docs.join(heavy.select("bits"), "bits", "left_anti").join(named.where(~large), "bits"))
    return joined.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
