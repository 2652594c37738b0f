from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of texts (or (text, lang, source)), with a column whose name an operator might use."""

    def make(texts, ids=None):
        rows = []
        for k, t in enumerate(texts):
            text, lang, source = t if isinstance(t, tuple) else (t, "en", "src")
            rows.append((k if ids is None else ids[k], text, lang, source, len(text or "")))
        return spark.createDataFrame(rows, DOCS)

    return make
