import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hit string, row string"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes ``documents`` of (doc_id, text) or (doc_id, text, source), with extra columns that operators use as names."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "y") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "a b c"), (4, "a b c"), (None, "one two three four five six"), (None, None), (7, LONG), (8, LONG), (9, "É ü   ß\x1c <|endoftext|> it's 12.5")]


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls, empty and very long texts, repeated rows."""
    return docs(ODD)


@pytest.fixture(scope="session")
def none(docs, odd):
    return odd.limit(0)
