"""Tables for the tests of the training-data operators."""

from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, word string, fp long, row long, taken long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns whose names clash
    with those that operators make."""
    plain = "the quick brown fox jumps over the lazy dog and the cat sat on the mat near the old mill by the river "
    rows = [
        (1, plain * 3, "en", "a"), (2, plain * 3, "en", "a"), (3, "", "en", "b"), (4, None, "en", None), (5, "   \t\n ", None, "b"), (6, "x" * 5000, "en", "a"),
        (7, "der schnelle braune fuchs springt über den faulen hund und die katze saß auf der matte " * 4, "de", "c"), (8, "12345 678 90", "de", "c"),
        (9, "word " * 20_000, "en", "a"), (None, plain, None, None), (10, plain + "ends otherwise", "en", "a"), (10, plain + "ends otherwise", "en", "a"), (11, "É à  ß \x0b\x0cz\x1cq", "fr", "b"),
    ]
    return spark.createDataFrame([(*r, None, 0.5, "w", 7, 8, 9) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
