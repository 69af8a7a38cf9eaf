from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, stats string, key string, size string"
ODD = [None, "", " \t\n", "x", "Straße naïve ÆØ 12,5 kg “quoted”", "a " * 30_000, "same words again and again in a row", "same words again and again in a row", "\x00\x1f odd control \x7f", "日本語の文章です。"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, a null id, a repeated row, and extra columns with clashing names."""
    rows = [(i, t, None if i % 3 else "en", "s", len(t or ""), "x", "y", "z", "w") for i, t in enumerate(ODD)]
    rows += [rows[7], (None, "no id here but some words to read", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
