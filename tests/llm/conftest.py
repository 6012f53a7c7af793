"""Small frames shared by the operator tests."""

from __future__ import annotations

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds a documents table; rows are (doc_id, text[, lang, source])."""
    def make(rows, extra=""):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), *r[4:]) for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA + extra)

    return make


EDGE_ROWS = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "  \n\t "), (None, "no id here"), (5, "word " * 30_000),
             (6, "Grüße, señor! <|endoftext|> a.b@c.de")]


@pytest.fixture
def edge_rows():
    return EDGE_ROWS
