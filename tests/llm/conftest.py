from __future__ import annotations

import pytest

#: Rows that every operator on documents must take: nulls, empty, long, ties, repeats.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "b"),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "b"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \t\n ", "de", ""),
    (6, "der schnelle braune fuchs springt über den faulen hund", "de", "a"),
    (None, "a text without an id but with a few words", "en", "c"),
    (None, None, None, None),
    (7, "x" * 5000 + " " + "word " * 3000, "en", "a"),
    (8, "😀 日本語 é\u0301 Σίσυφος İstanbul ﬁ <|endoftext|> don't 123", None, "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard int, ids string, score string, kept int, host string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of all odd kinds, with columns whose names operators also make."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "s", 1, "i", "x", 0, "h") for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with names that hold dots, differ in case from those that operators make, or stand for nothing."""
    names = ["a.b", "LANG_PRED", "Base", "IDS", "n`t", "PII", "Row_No", "mix_TIMES"]
    return odd.select("doc_id", "text", "lang", "source", "n_chars", *(odd["size"].alias(n) for n in names))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
