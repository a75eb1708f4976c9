import random

import pytest

WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu") for b in ("la", "me", "ni", "po", "ru", "st", "th")]


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(30)) for _ in range(n))


KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, size string, _ident string, label string, n int, ids string, path string, start int"


def row(doc_id, text, lang="en", source="a"):
    """A document with further columns whose names clash with those that operators use inside."""
    return (doc_id, text, lang, source, len(text or ""), 9.0, "k", "s", "i", "l", 7, "x", "p", 3)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, null ids and sources."""
    long = prose(1, 30_000)
    rows = [row(1, None), row(2, ""), row(3, " \n\t "), row(4, "one"), row(5, long), row(6, long), row(7, "one"), row(7, "one"), row(None, "one"), row(8, "x y", None, None), row(9, "日本語 😀", "zz", ""), row(None, None, None, None)]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], KIND)
