from __future__ import annotations

import random
import re

import numpy as np
import pytest

from granary.llm.components import components
from granary.llm.partenum import Bands, JoinSettings, fingerprints, gram_sets, jaccard_components, signatures, verified


def sets_of(texts, n):
    out = []
    for t in texts:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        out.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


def plain(ids, texts, n, percent):
    """n_shingles, component (least id) and number of links by comparing everything."""
    sets = sets_of(texts, n)
    links = [[j for j in range(len(sets)) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in range(len(sets))]
    out = []
    for i in range(len(sets)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        known = [ids[j] for j in seen if ids[j] is not None]
        out.append((ids[i], len(sets[i]), min(known) if known else None, len(links[i])))
    return sorted(out, key=str)


def corpus(seed, n=120):
    """Families of copies with few to many changed words, short texts and shared passages."""
    rng = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = ["", None, "a", "A", "a b", "a b c", "a b c d", "  a\tb\n"]
    while len(texts) < n:
        base = [f"w{rng.randrange(2000)}" for _ in range(rng.choice([3, 8, 20, 60, 150, 400]))]
        for _ in range(rng.randrange(1, 8)):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(words) // 12))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words) + (f" {passage}" if rng.random() < 0.3 else ""))
    return texts


@pytest.mark.parametrize("settings", [JoinSettings(), JoinSettings(words=5, percent=80, spare=0.2, few=1), JoinSettings(percent=70, cells=4, spoiled=2, block=300, bucket=500), JoinSettings(cells=1, spoiled=0, block=2000), JoinSettings(node_bits=4)])
def test_equals_comparing_everything(spark, settings):
    texts = corpus(settings.percent)
    ids = list(range(len(texts)))
    got = jaccard_components(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"), settings=settings)
    assert sorted(map(tuple, got.collect()), key=str) == plain(ids, texts, settings.words, settings.percent)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for settings in (JoinSettings(), JoinSettings(percent=80, spare=0.2, few=1), JoinSettings(percent=80, spare=0.1, few=3), JoinSettings(percent=60, cells=5, spoiled=2)):
        bands = Bands(settings)
        for _ in range(200):
            size = int(rng.choice([4, 9, 11, 30, 200, 1000]))
            common = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            spend = int(size * (100 - settings.percent) / settings.percent)  # |A xor B| of a pair that just links
            k = int(rng.integers(0, spend + 1))
            a = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, k, dtype=np.uint64)]))
            b = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, spend - k, dtype=np.uint64)]))
            if set(a.tolist()) == set(b.tolist()):
                continue
            assert 100 * len(np.intersect1d(a, b)) >= settings.percent * len(np.union1d(a, b))
            node, signature = signatures(np.array([len(a), len(b)]), np.concatenate([a, b]), bands, settings)
            assert set(signature[node == 0].tolist()) & set(signature[node == 1].tolist())


def test_verified_pairs_across_blocks():
    rng = random.Random(3)
    sets = [np.unique(np.array([rng.randrange(40) for _ in range(45)], np.uint64)) for _ in range(50)]
    want = {(i, j) for i in range(50) for j in range(i + 1, 50) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 50 * len(np.union1d(sets[i], sets[j]))}
    left, right = verified(sets, None, 50)
    assert {(min(p), max(p)) for p in zip(left.tolist(), right.tolist(), strict=True)} == want and len(left) == len(want) > 5
    side = np.arange(50) % 2
    left, right = verified(sets, side, 50)
    assert {(min(p), max(p)) for p in zip(left.tolist(), right.tolist(), strict=True)} == {p for p in want if side[p[0]] != side[p[1]]}


def test_sets_and_fingerprints_do_not_depend_on_the_batch():
    texts = [t.encode() for t in ("x y z x y z", "X Y  z\tx y z", "y z x", "", "q")]
    sizes, features, _ = gram_sets(texts, 3)
    assert sizes.tolist() == [3, 3, 1, 0, 1]
    a, b = fingerprints(sizes, features)
    assert a[0] == a[1] and b[0] == b[1] and a[0] != a[2]
    alone_sizes, alone, _ = gram_sets(texts[2:3], 3)
    assert fingerprints(alone_sizes, alone)[0][0] == a[2]


def test_components_equal_a_plain_search(spark):
    rng = random.Random(9)
    for n, m in ((30, 20), (30, 40), (50, 49)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + ([(k, k + 1) for k in range(49)] if n == 50 else [])
        got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
        root = {k: k for k in range(n)}
        for _ in range(n):
            for u, v in links:
                root[u] = root[v] = min(root[u], root[v])
        assert got == {k: root[k] for k in {x for u, v in links if u != v for x in (u, v)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted(map(tuple, jaccard_components(odd_docs).collect()), key=str)
    assert got == plain([i for i, _ in rows], [t for _, t in rows], 3, 90)
    assert jaccard_components(no_docs).count() == 0
