"""Tables with the odd rows that every operator has to stand."""

from __future__ import annotations

import pytest

CLASHING = "doc long, n long, h string, hashes string, bands string, component string, kept string, text_sha256 string, path string, class string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text, clashing names."""
    long = " ".join(f"word{i} and some more of it." for i in range(30_000))
    texts = [(1, "One two three four five six seven."), (2, "One two  three four five\tsix seven."), (3, None), (4, ""), (5, " \n\t "),
             (6, "short"), (7, "Short"), (None, "One two three four five six seven."), (None, None), (8, long), (9, long + " tail"),
             (6, "short"), (10, "ÀÉß 漢字   mixed ÀÉß"), (11, "a b c d e"), (11, "f g h i j"), (12, "emoji 😀 password: hunter22 end")]
    rows = [(i, t, None, None, None, 5, 6, "x", "y", "z", "w", "v", "u", "t", "s") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
