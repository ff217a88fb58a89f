"""Operators that SQL can express give the same rows in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from trailweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_in_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    found = queries.queries()[name](spark, sf)
    cur = con.execute(queries.oracle_sql()[name])
    assert [c[0] for c in cur.description] == found.columns
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r)) for r in found.collect())
