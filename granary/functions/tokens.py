"""Token arrays: encoding, wrapping, cropping, padding, shifting and loss masks, on array<int> columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.batches import PIECE_BYTES, list_bytes, spans, text_bytes, tidy
from granary.functions.text import shuffle_key, words

# The ids of the special tokens.
BOS, EOS, PAD, USER, BOT = 1, 2, 3, 4, 5
#: Ids below are kept for special tokens and bytes by the stand-in encoder.
FIRST_WORD, VOCABULARY = 16, 32_768


@dataclass(frozen=True)
class ChatTokens:
    """Ids of the special tokens of a chat example."""

    bos: int = BOS
    eos: int = EOS
    pad: int = PAD
    user: int = USER
    bot: int = BOT


def hashed_words(text: Column) -> Column:
    """A stand-in for a tokenizer, in SQL functions: one id for each word, from its hash."""
    return F.transform(words(text), lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % (VOCABULARY - FIRST_WORD) + FIRST_WORD).cast("int"))


def sentencepiece_ids(text: Column, model: Callable[[], str]) -> Column:
    """Ids by a SentencePiece model, in pieces of Arrow batches; `model` names the file on the worker. A null text is empty."""

    def run(batches):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model())
        for texts in batches:
            for lo, hi in spans(text_bytes(texts), PIECE_BYTES):
                yield _encoded(processor, texts.slice(lo, hi - lo))

    return _arrow(run, "array<int>")(text)


def sentencepiece_ids_of_each(texts: Column, model: Callable[[], str]) -> Column:
    """array<string> to array<array<int>>: the texts of a piece of an Arrow batch are encoded in one call (those of a longer row in several), and the rows' offsets kept.

    A null array stays null; a null text is empty.
    """

    def run(batches):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model())
        for batch in batches:
            for lo, hi in spans(list_bytes(batch), PIECE_BYTES):
                rows = batch.slice(lo, hi - lo)
                sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(rows.is_null().to_numpy(zero_copy_only=False), False))
                yield pa.ListArray.from_arrays(offsets, _encoded(processor, rows.flatten()))

    return _arrow(run, "array<array<int>>")(texts)


def _encoded(processor, texts: pa.Array) -> pa.Array:
    """Ids of each text, in pieces once more: the texts of one row may be many."""
    kind = pa.list_(pa.int32())
    parts = [pa.array(processor.encode(["" if t is None else t for t in texts.slice(lo, hi - lo).to_pylist()], num_threads=1), kind) for lo, hi in spans(text_bytes(texts), PIECE_BYTES)]
    return pa.concat_arrays([pa.array([], kind), *parts])


def _arrow(run: Callable, kind: str):
    """An iterator UDF over Arrow arrays, which may yield a batch in pieces."""
    run = tidy(run)
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def sentencepiece_chat_tokens(model: Callable[[], str], user: str = "<user>", bot: str = "<bot>") -> ChatTokens:
    """The special ids of a SentencePiece model; role tags are looked up by their pieces.

    A piece that the vocabulary lacks has the unknown id, as everywhere in SentencePiece; so has padding where there is none.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model())
    pad = p.pad_id() if p.pad_id() >= 0 else p.unk_id()
    return ChatTokens(p.bos_id(), p.eos_id(), pad, p.piece_to_id(user), p.piece_to_id(bot))


def sentencepiece_text(ids: Column, model: Callable[[], str]) -> Column:
    def run(batches):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model())
        for rows in batches:
            yield pd.Series([processor.decode([int(i) for i in r]) if r is not None else None for r in rows])

    return _iterated(run, "string")(ids)


def _iterated(f: Callable, kind: str):
    """An iterator UDF: its set-up is done once for all batches of a task."""
    f.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(f, kind)


def wrap(ids: Column) -> Column:
    return F.concat(F.array(F.lit(BOS)), ids, F.array(F.lit(EOS)))


def pad_to(ids: Column, length: int | Column, value: int = PAD) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def head(ids: Column, length: int) -> Column:
    """The oldest ids."""
    return F.slice(ids, 1, length)


def crop_start(ids: Column, block: int, seed: int, *key: Column) -> Column:
    """Zero-based start of a crop of `block` ids and their shifted targets; 0 for arrays that fit."""
    room = F.size(ids) - block
    draw = F.conv(F.substring(shuffle_key(seed, *key), 1, 8), 16, 10).cast("long")
    return F.when(room > 0, F.pmod(draw, room)).otherwise(0).cast("int")


def training_pair(ids: Column, block: int, start: Column, pad: int = PAD) -> tuple[Column, Column]:
    """Inputs and next-token targets of `block` ids each, padded.

    The last id of an array is a target only, so one that fits the block gives up its last input.
    """
    inputs = F.slice(ids, start + 1, F.greatest(F.least(F.size(ids) - 1, F.lit(block)), F.lit(0)))
    return pad_to(inputs, block, pad), pad_to(F.slice(ids, start + 2, block), block, pad)


def each(encode: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """An encoder of array<string> from one of texts in SQL functions."""
    return lambda texts: F.transform(texts, encode)


def said(messages: Column) -> Column:
    """The messages that take part in an example: of users and assistants, with a text."""
    return F.filter(messages, lambda m: m["role"].isin("user", "assistant") & m["content"].isNotNull())


def chat_ids(messages: Column, encode: Callable[[Column], Column], tokens: ChatTokens = ChatTokens()) -> tuple[Column, Column]:
    """Token ids of user and assistant messages with role tags, and the loss mask of the same length.

    `encode` turns array<string> into array<array<int>>. The mask is 1 over an assistant's tag,
    content and end, and 0 elsewhere. Other roles and null contents are passed over.
    """
    kept = said(messages)
    both = F.arrays_zip(F.transform(kept, lambda m: m["role"] == "assistant").alias("bot"), encode(F.transform(kept, lambda m: m["content"])).alias("ids"))
    tag = lambda x: F.when(x["bot"], tokens.bot).otherwise(tokens.user)
    segments = F.transform(both, lambda x: F.struct(x["bot"].cast("int").alias("on"), F.concat(F.array(tag(x)), x["ids"], F.array(F.lit(tokens.eos))).alias("ids")))
    ids = F.concat(F.array(F.lit(tokens.bos)), F.flatten(F.transform(segments, lambda s: s["ids"])))
    mask = F.concat(F.array(F.lit(0)), F.flatten(F.transform(segments, lambda s: F.array_repeat(s["on"], F.size(s["ids"])))))
    return ids, mask


def chat_example(ids: Column, mask: Column, block: int, pad: int = PAD) -> tuple[Column, Column, Column]:
    """Inputs, next-token targets and the targets' loss mask of `block` each, padded.

    The mask belongs to the targets, so it is shifted with them.
    """
    inputs, targets = training_pair(ids, block, F.lit(0), pad)
    return inputs, targets, pad_to(F.slice(mask, 2, block), block, 0)
