"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, score double, h long, sid long, copies long"


def sentence(rng: random.Random, n: int, words: list[str]) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


def odd_rows() -> list[tuple]:
    """doc_id, text, lang, source: null, empty, blank, tiny, repeated, long and odd texts."""
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "ka lo mi ne ru sta pre vol".split() for b in "na do ti re sun mar".split()]
    long = sentence(rng, 4000, vocabulary)
    base = sentence(rng, 120, vocabulary)
    near = base.replace(base.split()[60], "changed", 1)
    return [
        (1, None, "en", "a"),
        (2, "", "en", None),
        (3, " \t\n\x0b ", None, "a"),
        (4, "one", "en", "b"),
        (5, "One", "en", "b"),
        (6, base, "en", "a"),
        (7, base, "de", "a"),
        (7, base, "de", "a"),
        (8, near, "en", "c"),
        (9, long, "en", "a"),
        (None, long, "en", "a"),
        (10, "x" * 5000, "fr", "b"),
        (11, "日本語 のテキスト 😀   ok <|endoftext|> é", "ja", "c"),
        (12, "the the the the the " * 30, "en", "c"),
        (13, "line\nline\n\nother\nline", "en", "c"),
        (14, base.upper(), "en", "a"),
    ]


def documents(spark, rows=None):
    """The rows with further columns whose names clash with what operators use inside."""
    rows = odd_rows() if rows is None else rows
    return spark.createDataFrame([(i, t, la, s, len(t or ""), "w", 0.5, 7, 8, 9) for i, t, la, s in rows], DOC_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
