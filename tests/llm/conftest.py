import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"
LONG = "Lorem ipsum dolor, " * 20_000
#: Nulls in every column, empty and very long texts, ties, rows repeated in full, copies in other case.
EDGES = [
    (None, None, None, None), (1, None, None, None), (2, "", "en", "a"), (3, "", "en", "a"), (4, " \n\t", None, "b"), (5, "One two THREE four", "en", None),
    (6, "one two three FOUR", "en", "b"), (6, "one two three FOUR", "en", "b"), (None, "one two three four", None, "b"), (7, LONG, "la", "c"), (8, LONG.upper(), "la", "c"),
    (9, "Straße ÄÖ 日本 語 \U0001f600", "de", "c"), (10, "straße äö 日本 語 \U0001f600", "de", "d"), (11, "word", None, "Z"), (12, "two words", None, "z"),
    (13, "<|endoftext|> it's  here now\r\n\r\n x", "en", "é"), (14, "1234 .,!", "en", "d"), (-5, "negative id", "en", "d"),
]


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("needs the generated tables")
    return SF


@pytest.fixture(scope="session")
def edges(spark):
    """The edge rows with more columns, some named like those that operators make."""
    rows = [(*r, "x", 1, 2, "k", 0.5) for r in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row string, size int, n int, key string, score double")


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
