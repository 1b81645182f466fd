"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of turns to a string. `trace` learns where each turn stands
without looking into it: it renders successive prefixes of a conversation and compares consecutive
outputs. If an output begins with the one before, what is new is the turn's span; if not, the
template rewrites history at that turn. Where inside its span a turn's text stands is found by
rendering the turn with a marker for its text.

Rendering all prefixes takes time with the square of the number of turns, but only two outputs are
held at a time. For templates known to be local, `window` is an approximation that isn't on unless
asked for: each step then renders only the last `window` turns, with and without the newest, and all
prefixes after all if the spans in a row don't equal one rendering of the whole conversation. It
misses what a template rewrites at some prefixes and undoes later.

`bracket_template` is the template used here. It marks turns with control strings and escapes
control strings inside texts by a backslash after their first character (and doubles backslashes),
which `parse` undoes.

Defined results: turns are ordered by number (null first), ties by role, then text (null first).
A null text is empty; a null role is the empty role; any other role than user, assistant and system
is written out by name, escaped. A null conversation id is a conversation of its own; repeated rows
are turns of their own. An empty table gives an empty result. Only the four named columns are
read, so further columns can't clash. A conversation is formatted as one string, so a worker holds
one conversation at a time; batches of conversations are cut to a bounded number of turns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[END]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_SPECIAL = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_ESCAPED = re.compile(r"\\(.)", re.S)
#: Stands for a turn's text while its place is looked for; chosen so that no escaping touches it.
_MARK = "\ue000\ue001\ue000"


def _escaped(text: str) -> str:
    return _SPECIAL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


#: Short texts recur in every prefix.
_remembered = lru_cache(4096)(_escaped)


def escape(text: str) -> str:
    return _remembered(text) if len(text) <= 4096 else _escaped(text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def bracket_template(turns: list[Turn]) -> str:
    out = ["<s>"] if turns else []
    for role, text in turns:
        body = escape(text)
        if role == "user":
            out.append(f"[INST] {body} [/INST]")
        elif role == "assistant":
            out.append(f" {body}</s>")
        elif role == "system":
            out.append(f"[SYS] {body} [/SYS]")
        else:
            out.append(f"[ROLE]{escape(role)}[/ROLE] {body} [END]")
    return "".join(out)


def parse(formatted: str) -> list[Turn]:
    """The turns that bracket_template wrote."""
    out: list[Turn] = []
    at, role, named = 0, None, ""
    for m in [*_CONTROL.finditer(formatted), None]:
        body = formatted[at : m.start() if m else len(formatted)]
        at = m.end() if m else len(formatted)
        token = m[0] if m else ""
        if token in ("[/INST]", "[/SYS]", "[END]"):
            out.append((named, unescape(body[1:-1])))
            role = None
        elif token == "</s>":
            out.append(("assistant", unescape(body[1:])))
        elif token == "[/ROLE]":
            named = unescape(body)
        elif token == "[INST]":
            named = "user"
        elif token == "[SYS]":
            named = "system"
    assert role is None
    return out


@dataclass
class Trace:
    formatted: str
    #: of each turn, the span it added and the place of its text: start, end, text start, text end; -1 if there is none
    spans: list[tuple[int, int, int, int]]
    #: turns at which the template changed what it had written before
    rewrites: list[int]


def _text_place(template: Template, before: str, context: list[Turn], turn: Turn, span: str) -> tuple[int, int]:
    """Where the turn's text stands in its span, from a rendering with a marker as its text."""
    marked = template([*context, (turn[0], _MARK)])
    if not marked.startswith(before) or marked.count(_MARK) != before.count(_MARK) + 1:
        return -1, -1
    head, _, tail = marked[len(before) :].partition(_MARK)
    if len(head) + len(tail) <= len(span) and span.startswith(head) and span.endswith(tail):
        return len(head), len(span) - len(tail)
    return -1, -1


def _prefixes(template: Template, turns: list[Turn], window: int | None) -> tuple[list[tuple[str, int, int]], list[int]]:
    """What each turn adds, with its text's place in it, and the turns that rewrite."""
    added, rewrites, last = [], [], template([])
    for k, turn in enumerate(turns):
        low = 0 if window is None else max(0, k - window)
        context = turns[low:k]
        before = last if low == 0 else template(context)
        now = template([*context, turn])
        last = now
        if now.startswith(before):
            span = now[len(before) :]
            added.append((span, *_text_place(template, before, context, turn, span)))
        else:
            rewrites.append(k)
            added.append(("", -1, -1))
    return added, rewrites


def trace(template: Template, turns: list[Turn], window: int | None = None) -> Trace:
    whole = template(turns)
    first = template([])
    added, rewrites = _prefixes(template, turns, window)
    if window is not None and len(turns) > window and (rewrites or first + "".join(a for a, _, _ in added) != whole):
        added, rewrites = _prefixes(template, turns, None)
    spans, at = [], len(first)
    for k, (span, low, high) in enumerate(added):
        known = k not in rewrites and whole.startswith(span, at)
        spans.append((at, at + len(span), at + low if low >= 0 else -1, at + high if high >= 0 else -1) if known and not rewrites else (-1, -1, -1, -1))
        at += len(span)
    return Trace(whole, spans, rewrites)


_SCHEMA = "formatted string, spans array<struct<role:string,start:long,end:long,text_start:long,text_end:long,loss:boolean>>, rewrites array<int>"
_SPANS = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_())]))
_TURNS = 4_096


def format_conversations(
    df: DataFrame, template: Template = bracket_template, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant", window: int | None = None
) -> DataFrame:
    """One row for each conversation: its id, the formatted string, the turns' spans with the loss mask, rewrites.

    Span offsets are code points of the formatted string; a turn has a loss if its role is loss_role.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = df.select(F.col(conv_col).alias("conv"), turn.alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    kind = grouped.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            conv, formatted, spans, rewrites = (list(x) for x in zip(*rows, strict=True))
            arrays = [pa.array(conv, kind_of), pa.array(formatted, pa.string()), pa.array(spans, _SPANS), pa.array(rewrites, pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(arrays, names=["conv", "formatted", "spans", "rewrites"])

        for batch in batches:
            kind_of, rows, held = batch.schema.field("conv").type, [], 0
            for k in range(batch.num_rows):
                turns = [(t["role"], t["text"]) for t in batch.column("turns")[k].as_py()]
                got = trace(template, turns, window)
                spans = [{"role": role, "start": a, "end": b, "text_start": c, "text_end": d, "loss": role == loss_role} for (role, _), (a, b, c, d) in zip(turns, got.spans, strict=True)]
                rows.append((batch.column("conv")[k].as_py(), got.formatted, spans, got.rewrites))
                held += len(turns)
                if held >= _TURNS:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    return grouped.mapInArrow(run, f"conv {kind}, {_SCHEMA}").withColumnRenamed("conv", conv_col)


def read_back(df: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """From format_conversations' rows: the turns that the formatted string holds, and its text under the loss mask, unescaped."""
    source = df.select(F.col(conv_col).alias("conv"), "formatted", "spans")
    kind = source.schema["conv"].dataType.simpleString()
    turn_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            formatted = batch.column("formatted").to_pylist()
            spans = batch.column("spans").to_pylist()
            turns = [[{"role": r, "text": t} for r, t in parse(x)] for x in formatted]
            loss = ["".join(unescape(x[s["text_start"] : s["text_end"]]) for s in ss if s["loss"] and s["text_start"] >= 0) for x, ss in zip(formatted, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(turns, turn_type), pa.array(loss, pa.string()), batch.column("formatted")], names=["conv", "turns", "loss_text", "formatted"])

    return source.mapInArrow(run, f"conv {kind}, turns array<struct<role:string,text:string>>, loss_text string, formatted string").withColumnRenamed("conv", conv_col)
