from __future__ import annotations

import pytest
from pyspark.sql import DataFrame


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of (doc_id, text) rows with extra columns whose names clash with results."""

    def make(rows: list[tuple]) -> DataFrame:
        full = [(i, t, "en", "s", len(t or ""), "x", "y", 7) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, h string, spans string, score int").repartition(3)

    return make
