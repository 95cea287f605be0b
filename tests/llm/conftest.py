from __future__ import annotations

import pytest

TEXTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A table of documents from texts (ids from 0) or (id, text[, lang]) rows."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            doc_id, text, lang = (*r, "en")[:3]
            full.append((doc_id, text, lang, "src", len(text) if text is not None else None))
        return spark.createDataFrame(full, TEXTS).repartition(3)

    return make


@pytest.fixture
def clashing(docs):
    """The same table with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ["key", "row", "rep", "comp", "node", "u", "v", "runs", "first", "last", "h", "s", "at", "ids", "decoded", "grams", "bands", "hi", "lo", "fp", "score", "island", "n_lines", "kept", "label"]

    def make(rows):
        df = docs(rows)
        for n in names:
            df = df.withColumn(n, F.lit("x"))
        return df

    return make
