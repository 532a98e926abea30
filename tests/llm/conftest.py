from __future__ import annotations

import pytest
from codeloom.llm.common import Scratch


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from texts (or (doc_id, text[, source])), with extra columns whose names clash with common ones."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            doc_id, text, source = (*r, "s")[:3]
            full.append((doc_id, text, "en", source, len(text or ""), 7, "x", 1, 2))
        return spark.createDataFrame(full, DOCS + ", n int, key string, size int, node int")

    return make
