from __future__ import annotations

import pytest

LONG = "lorem ipsum dolor " * 4000 + "end"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and keys, columns with names that
    operators use themselves."""
    rows = [
        (1, "one two three four five six seven", "a"),
        (1, "one two three four five six seven", "a"),
        (2, "one two three four five six seven", None),
        (2, "another text under the same key as before", "a"),
        (None, "a text without a key stands here alone", "b"),
        (None, None, None),
        (3, "", "b"),
        (4, None, "b"),
        (5, LONG, "a"),
        (6, "caf\u00e9 \U0001f642 \u65e5\u672c  <|endoftext|>\n\n tail ", "b"),
    ]
    rows = [(*r, "text", 7, b"x", 0.5, 1) for r in rows]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, source string, `key` string, n_tokens int, `row` binary, score double, `a.b` int",
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
