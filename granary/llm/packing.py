"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised by `tokenizers` and end with a separator id; only those longer than a
sequence are cut. The pieces are dealt by a hash of their row number (so equal rows are spread, too)
over blocks of a bounded expected number of pieces, and each block is packed on a histogram of its lengths: a sequence takes the longest
piece left, then always the longest that fits; if a gap remains, the sequence's smallest piece is
swapped for the two unpacked pieces that fill the gap and its place most tightly, if any two do
better. A block leaves at most a few sequences part-filled, so blocks cost a small share of
sequences and no task ever holds more than one block's lengths.

Words are tokenised once and remembered by a worker (in two generations of bounded size): the
tokenizer's pre-tokenizer never joins characters across white space, so the ids of a text are the
ids of its words in order.

Defined results: a null text counts as empty and is one piece with the separator alone; equal rows
give equal pieces, each packed for itself; null ids are kept; a very long text is cut into whole
sequences and a rest. Sequence numbers are distinct but arbitrary. Only id and text are read, so
further columns can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import checkpointed, pieces


@dataclass(frozen=True)
class PackSettings:
    length: int = 2048
    separator: int = 0
    block_docs: int = 16_384  # of documents; pieces of long ones come on top
    #: Distinct words that a worker remembers, in each of two generations.
    remembered: int = 250_000


#: Words whose pieces the model can be asked for directly: letters that lower-casing and NFC leave single.
_PLAIN = re.compile(r"[\x21-\x7EÀ-ÖØ-öø-ÿ]+")
#: The pre-tokenizer's pattern on such words, lower-cased.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes, remembered by word."""

    def __init__(self, path: str, remembered: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.limit = remembered
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            if _PLAIN.fullmatch(word) and "<|" not in word:
                ids: list[int] = []
                for part in _PIECE.findall(word.lower()):
                    mapped = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
                    ids += [t.id for t in self.model.tokenize(mapped)]
            else:
                ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            found = np.array(ids, "<u4").tobytes()
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[word] = found
        return found

    def encode(self, text: str) -> bytes:
        # white space of any kind never belongs to a token; ASCII space, tab and line feed are enough to cut at
        words = text.replace("\n", " ").replace("\t", " ").split(" ")
        young = self.young
        out = []
        for w in words:
            if (found := young.get(w)) is None:
                found = self.word(w)
                young = self.young
            out.append(found)
        return b"".join(out)


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def _encoder(path: str, remembered: int) -> WordEncoder:
    if (path, remembered) not in _ENCODERS:
        _ENCODERS[path, remembered] = WordEncoder(path, remembered)
    return _ENCODERS[path, remembered]


def token_pieces(df: DataFrame, tokenizer_path: Callable[[], str], id_col: str = "doc_id", text_col: str = "text", settings: PackSettings = PackSettings(), with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, and ids if asked for.

    tokenizer_path is called on the workers, where the vocabulary file lies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path(), settings.remembered)
        separator = np.array([settings.separator], "<u4").tobytes()
        for piece in pieces(batches, "text"):
            rows, numbers, starts, sizes, sums, ids = [], [], [], [], [], []
            for row, text in enumerate(piece.column("text").to_pylist()):
                data = encoder.encode(text or "") + separator
                for k, at in enumerate(range(0, len(data), 4 * settings.length)):
                    part = data[at : at + 4 * settings.length]
                    rows.append(row)
                    numbers.append(k)
                    starts.append(at // 4)
                    sizes.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            arrays = [piece.column("id").take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, sizes, sums))]
            arrays += [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
    return out.withColumnRenamed("id", id_col)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    lengths = np.asarray(lengths, np.int64)
    counts = np.bincount(lengths, minlength=capacity + 1)
    present = np.flatnonzero(counts)  # ascending lengths with pieces left
    bins: list[list[int]] = []

    def fitting(room: int) -> int:
        """The longest length left that is at most room; 0 if none."""
        k = int(np.searchsorted(present, room, "right"))
        return int(present[k - 1]) if k else 0

    def take(size: int) -> None:
        nonlocal present
        counts[size] -= 1
        if not counts[size]:
            present = present[present != size]

    def give(size: int) -> None:
        nonlocal present
        if not counts[size]:
            present = np.insert(present, np.searchsorted(present, size), size)
        counts[size] += 1

    while len(present):
        room, content = capacity, []
        while size := fitting(room):
            take(size)
            content.append(size)
            room -= size
        if room and len(content) > 1 and len(present):
            small = content[-1]  # taken in descending order
            wide = room + small
            a = present[present < wide]
            if len(a):
                k = np.searchsorted(present, wide - a, "right") - 1
                b = np.where(k >= 0, present[np.maximum(k, 0)], 0)
                alone = (b == a) & (counts[a] < 2)  # the only piece of its length can't be both
                lower = np.where(k > 0, present[np.maximum(k - 1, 0)], 0)
                b = np.where(alone, lower, b)
                both = np.where(b > 0, a + b, 0)
                best = int(np.argmax(both))
                if both[best] > small:
                    content.pop()
                    give(small)
                    for size in (int(a[best]), int(b[best])):
                        take(size)
                        content.append(size)
        bins.append(content)
    order = np.argsort(lengths, kind="stable")
    next_of = np.searchsorted(lengths[order], np.arange(capacity + 2)).tolist()
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for number, content in enumerate(bins):
        at = 0
        for size in content:
            row = order[next_of[size]]
            next_of[size] += 1
            sequence[row], offset[row] = number, at
            at += size
    return sequence, offset


def pack_pieces(parts: DataFrame, docs: int, id_col: str = "doc_id", settings: PackSettings = PackSettings()) -> DataFrame:
    """Adds sequence_id and offset to the rows of token_pieces (or any with id, piece, start, length).

    docs: the number of documents, from which the number of blocks follows. The rows should come from a
    checkpoint or a table, since blocks follow from their numbers.
    """
    blocks = max(1, -(-docs // settings.block_docs))
    dealt = parts.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    names = parts.columns

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = best_two_fit(group["length"].to_numpy(), settings.length)
        out = group[names].copy()
        out["sequence_id"] = sequence + (int(group["block"].iloc[0]) << 40)
        out["offset"] = offset
        return out

    return dealt.groupBy("block").applyInPandas(run, schema)


def pack_documents(df: DataFrame, tokenizer_path: Callable[[], str], id_col: str = "doc_id", text_col: str = "text", settings: PackSettings = PackSettings()) -> DataFrame:
    """Where each piece of each document stands."""
    # a few numbers a piece; blocks follow from the pieces' numbers, which a task that runs again must not change
    parts = checkpointed(token_pieces(df, tokenizer_path, id_col, text_col, settings))
    return pack_pieces(parts, df.count(), id_col, settings)


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
