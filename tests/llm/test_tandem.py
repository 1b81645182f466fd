from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from granary.llm.queries import op13_periodic_runs, repeat_words
from granary.llm.tandem import RunSettings, Suffixes, covering_stretches, find_runs, periodic_runs


def plain(words, least=24, exponent=3):
    """Runs by comparing the text with itself at every distance."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def some_text(rng):
    out, kinds = [], rng.choice([1, 2, 3, 5, 50])
    for _ in range(rng.randrange(8)):
        c = rng.random()
        if c < 0.4:
            period = [rng.randrange(kinds) for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 12, 20]))]
            times = rng.randrange(1, rng.choice([4, 10, 30]))
            out += (period * times)[: len(period) * times - rng.randrange(len(period))]
        elif c < 0.6 and out:
            at = rng.randrange(len(out))
            out += out[at : at + rng.randrange(1, 60)]
        else:
            out += [rng.randrange(kinds) for _ in range(rng.randrange(30))]
    return [str(w).encode() for w in out]


@pytest.mark.parametrize("settings", [RunSettings(), RunSettings(6, 3), RunSettings(5, 2), RunSettings(4, 2), RunSettings(20, 4)])
def test_equals_comparing_everything(settings):
    rng = random.Random(settings.least)
    found = 0
    for _ in range(60):
        texts = [some_text(rng) for _ in range(rng.randrange(1, 6))]
        expected = [plain(t, settings.least, settings.exponent) for t in texts]
        assert find_runs(texts, settings) == expected
        found += sum(map(len, expected))
    assert found > 100


def test_suffix_array_and_extensions():
    rng = random.Random(2)
    x = np.array([rng.randrange(3) for _ in range(200)] + [9])
    s, words = Suffixes(x), x.tolist()
    assert s.array.tolist() == sorted(range(201), key=lambda k: words[k:])
    for _ in range(300):
        i, j = rng.sample(range(201), 2)
        ahead = next((k for k in range(201) if max(i, j) + k >= 201 or words[i + k] != words[j + k]), 0)
        behind = next(k for k in range(202) if min(i, j) - k < 0 or words[i - k] != words[j - k])
        assert int(s.ahead(np.array([i]), np.array([j]))[0]) == ahead and int(s.behind(np.array([i]), np.array([j]))[0]) == behind
        length = rng.randrange(1, 6)
        if i + length <= 200:
            low, high = s.node(np.array([i]), np.array([length]))
            inside = [k for k in range(201) if words[k : k + length] == words[i : i + length]]
            assert sorted(s.array[int(low[0]) : int(high[0])].tolist()) == inside


def test_stretches_cover_the_leftmost_of_each_repeat():
    rng = random.Random(4)
    for _ in range(60):
        x = np.array([rng.randrange(rng.choice([2, 3])) for _ in range(80)] + [9])
        words = x.tolist()
        stretches = list(zip(*(c.tolist() for c in covering_stretches(x, Suffixes(x))), strict=True))
        seen = set()
        for i in range(80):
            for k in range(1, 40):
                square = tuple(words[i : i + 2 * k])
                primitive = all(square[:k] != square[:d] * (k // d) for d in range(1, k) if k % d == 0)
                if i + 2 * k <= 80 and square[:k] == square[k:] and primitive and square not in seen:
                    seen.add(square)
                    assert any(b <= i and i + 2 * k <= e and q == k for b, e, q in stretches)


def plain_row(doc_id, text):
    words = [w for w in (text or "").encode().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_plain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = op13_periodic_runs(spark, sf)
    assert rows.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(map(tuple, rows.collect()))
    assert got == sorted(plain_row(r.doc_id, r.text) for r in docs) and sum(r[1] for r in got) > 10


def test_rewriting_follows_the_rule():
    for doc_id in range(200):
        words = [str(k).encode() for k in range(doc_id % 50)]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        a = g % n if n else 0
        p = 1 + (n - a) // (3 + g % 8)
        expected = [words[i] if h % 10 or i < a else words[a + (i - a) % p] for i in range(n)]
        assert repeat_words(str(doc_id), words) == expected


def test_odd_rows(spark, odd_docs, no_docs):
    rows = periodic_runs(odd_docs).collect()
    assert len(rows) == odd_docs.count() and not any(r.runs for r in rows)
    assert {r.collapsed for r in rows if r.doc_id in (2, 3, 4)} == {""}
    assert periodic_runs(no_docs).count() == 0
    texts = [(None, "a b " * 30), (1, "a b " * 30), (2, "é \t" * 24), (2, "é \t" * 23)]
    found = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(spark.createDataFrame(texts, "doc_id long, text string"), repeat_words).collect()]
    assert found[0] == (None, [(0, 60, 2)], "a b") and found[2:] == [(2, [(0, 24, 1)], "é"), (2, [], " ".join("é" * 23))]


def test_very_long_text():
    words = [str(k % 7001).encode() for k in range(30_000)]
    assert find_runs([words, [b"a"] * 50_000]) == [[(0, 30_000, 7001)], [(0, 50_000, 1)]]
