from __future__ import annotations

import hashlib
import random

import pytest

from granary.llm import queries
from granary.llm.chat_render import CONTROL, bracket_template, escape, format_conversations, parse, read_back, trace, unescape


def conversations(seed):
    rng = random.Random(seed)
    bits = [*CONTROL, "\\", "<", "/s>", "[", " ", "\n", "é\U0001f600", "word", "[INST", "\\</s>"]
    return [(rng.choice(["user", "assistant", "system", "tool", "", "[INST]"]), "".join(rng.choice(bits) for _ in range(rng.randrange(6)))) for _ in range(rng.randrange(1, 90))]


def test_escaping_is_reversible_and_hides_control_strings():
    for seed in range(200):
        for _, text in conversations(seed):
            assert unescape(escape(text)) == text
            assert not any(c in escape(text) for c in CONTROL)


def test_parse_undoes_the_template():
    for seed in range(100):
        turns = conversations(seed)
        assert parse(bracket_template(turns)) == turns
    assert parse("") == [] == parse(bracket_template([]))


def test_spans_and_text_places():
    for seed in range(60):
        turns = conversations(seed)
        whole = bracket_template(turns)
        for window in (None, 1, 4, 32):
            got = trace(bracket_template, turns, window)
            assert got.formatted == whole and not got.rewrites
            assert [whole[c:d] for _, _, c, d in got.spans] == [escape(t) for _, t in turns]
            assert [b for _, b, _, _ in got.spans[:-1]] == [a for a, _, _, _ in got.spans[1:]] and got.spans[-1][1] == len(whole)


def hides_old_thoughts(turns):
    """Keeps only the last assistant turn."""
    last = max((k for k, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
    return "".join(f"<{r}>{t if r != 'assistant' or k == last else '...'}" for k, (r, t) in enumerate(turns))


def counts_turns(turns):
    return f"{len(turns)} turns:" + "".join(t for _, t in turns)


def looks_far_back(turns):
    return "".join(f"<{r}>{t}" + (f"#{k}" if k >= 3 else "") for k, (r, t) in enumerate(turns))


@pytest.mark.parametrize("window", [None, 2, 32])
def test_rewritten_history_is_detected(window):
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "e")]
    got = trace(hides_old_thoughts, turns, window)
    assert got.rewrites == [3] and all(s == (-1, -1, -1, -1) for s in got.spans)
    assert trace(counts_turns, turns, window).rewrites == [0, 1, 2, 3, 4]


def test_a_template_that_looks_further_back_than_the_window():
    turns = [("user", str(k)) for k in range(12)]
    whole = looks_far_back(turns)
    got = trace(looks_far_back, turns, 2)
    assert got.formatted == whole and [whole[c:d] for _, _, c, d in got.spans] == [t for _, t in turns]


def test_odd_rows(spark):
    rows = [(1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (1, None, None, "z", "x"), (None, 1, "assistant", "</s>", "x"), (2, 5, "assistant", "a" * 200_000, "x"), (3, 0, "user", "", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    read = {r.conv_id: r for r in read_back(format_conversations(df)).collect()}
    turns = {k: [(t.role, t.text) for t in r.turns] for k, r in read.items()}
    assert turns == {1: [("", "z"), ("user", ""), ("user", "")], None: [("assistant", "</s>")], 2: [("assistant", "a" * 200_000)], 3: [("user", "")]}
    assert {k: r.loss_text for k, r in read.items()} == {1: "", None: "</s>", 2: "a" * 200_000, 3: ""}
    assert read_back(format_conversations(df.limit(0))).count() == 0


def test_a_long_conversation(spark):
    turns = [(7, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(3000)]
    r = read_back(format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).first()
    assert [t.text for t in r.turns] == [t[3] for t in turns]
    assert r.loss_text == "".join(t[3] for t in turns if t[2] == "assistant")


def test_query_against_plain_python(spark, sf):
    turns = {}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    turns[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = queries.op7_chat_rendering(spark, sf).collect()
    assert len(rows) == len(turns)
    for r in rows:
        t = turns[r.conv_id]
        loss = "".join(x for role, x in t if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(t), digest("".join(f"{a}\n{b}\n" for a, b in t)))
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), digest(loss), len(bracket_template(t)))


def marks_some_lengths(turns):
    """Puts a mark in front of 36 to 40 turns only."""
    return ("#" if 36 <= len(turns) <= 40 else "") + "".join(f"<{r}>{t}" for r, t in turns)


def test_rewrites_that_are_undone_are_detected(spark):
    turns = [("user" if k % 2 else "assistant", f"t{k}") for k in range(60)]
    assert trace(marks_some_lengths, turns).rewrites == trace(marks_some_lengths, turns, None).rewrites == [35, 40]
    rows = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    assert format_conversations(rows, marks_some_lengths).first().rewrites == [35, 40]


def test_hundreds_of_turns():
    turns = [("user" if k % 2 else "assistant", f"text {k} " * 20) for k in range(400)]
    got = trace(bracket_template, turns)
    assert not got.rewrites and [got.formatted[c:d] for _, _, c, d in got.spans] == [t for _, t in turns]
