from __future__ import annotations

import pytest

ODD_ROWS = [
    (1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "zz", "a"), (4, "word", "en", "b"),
    (5, "the same line of text here\nthe same line of text here", "en", "a"),
    (5, "the same line of text here\nthe same line of text here", "en", "a"),
    (5, "another text under the id that is taken", "en", "a"),
    (None, "a text without an id but with the words", "en", "a"), (None, None, None, None),
    (9, "long " * 30_000, "en", "a"), (10, "é 漢字 ÄÖ\x85 ..." * 3, "fr", "x.y"),
]


@pytest.fixture(scope="session")
def small(spark):
    """The smallest documents table, as a frame and as rows."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and long texts, repeated rows and ids, and clashing columns."""
    df = spark.createDataFrame(ODD_ROWS, "doc_id long, text string, lang string, source string")
    clashing = ("key", "content", "shard", "size", "row", "batch", "pos", "fp", "root", "value",
                "part", "anchor", "wanted", "marks", "class", "item_id", "carried", "host",
                "domain", "declared", "vote", "next", "before", "range", "n_words", "spans", "s")
    for name in clashing:
        df = df.selectExpr("*", f"'x' as `{name}`")
    return df


@pytest.fixture
def docs(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, text string")
    return make
