from __future__ import annotations

import pytest

#: Columns whose names the operators use inside.
CLASHING = "path string, blob string, spans string, h string, seed string, fp string, node string, block string, role string, share string, u string, component_id string"


@pytest.fixture(scope="session")
def documents(spark):
    """rows (doc_id, text[, lang]) -> a frame with columns whose names clash with the operators' own."""
    extra = ["-"] * len(CLASHING.split(", "))

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", *extra) for r in rows], f"doc_id long, text string, lang string, {CLASHING}")

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, white space, other scripts, repeated rows."""
    long = "lorem ipsum dolor sit amet consectetur " * 4000
    return [(1, None), (2, ""), (3, " \t\n "), (4, "word"), (None, "no id here"), (5, long), (6, "éèê ßö 漢字 😀 İſK"), (7, "same row"), (7, "same row"), (8, "x" * 50_000), (9, "a\x00b\x1cc")]
