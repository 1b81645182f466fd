from __future__ import annotations

import os
import random

import pytest

SF = "/root/testdata/sf0.001"

#: Names that operators use inside; as further columns they must do no harm.
CLASHING = "id string, n int, a int, b int, words string, blob string, size int, key double, range int, kept int, score int, block int, spans string, media string, payload string, node string"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, equal ids, clashing names."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(3000)}" for _ in range(40_000)]
    rows = [
        (1, "The apache license. password = abcdef123 \n a b", "en", "s1", 5),
        (2, None, None, None, None),
        (3, "", "en", "s1", 0),
        (4, " \t\n\r\x0b\x0c ", "en", "s2", 7),
        (5, " ".join(words), "en", "s1", 1),
        (6, " ".join(words[:-40]) + " tail", "en", "s1", 1),
        (7, "one two", "en", None, 1),
        (7, "one two", "en", None, 1),
        (7, "one  TWO", "en", None, 1),
        (None, "one two", None, "s2", 1),
        (None, None, "de", "s2", 1),
        (8, "naïve 你好 мир \U0001f600 mit license MIT License", "xx", "s3", 9),
        (9, "x" * 300_000, "en", "s1", 1),
    ]
    clash = tuple(None for _ in CLASHING.split(","))
    return spark.createDataFrame([r + clash for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
