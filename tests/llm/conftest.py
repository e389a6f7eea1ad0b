from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names clash."""
    rows = [
        (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \n\t ", "en", None, 0), (4, "one two three", "en", "b", 0),
        (5, "word " * 30_000, "en", "b", 0), (6, "Same text here for two rows, the very same text.", "fr", "b", 0), (6, "Same text here for two rows, the very same text.", "fr", "b", 0),
        (7, "Same text here for two rows, the very same text.", "fr", "b", 0), (8, "Mail me at a.b@c.org or +1 (988) 555-2485 é.", "en", "a", 0), (None, "no id but a text", "en", "a", 0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 AS size", "'x' AS component", "2 AS copies", "3 AS key", "4 AS spans", "5 AS n_words", "6 AS z", "7 AS slot", "8 AS `a.b`")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
