"""Small tables of the shapes that the operators read."""

from __future__ import annotations

import pytest

DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from (doc_id, text, lang, source) rows."""

    def make(rows):
        full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make
