"""Every registered query with SQL gives the same rows in DuckDB; the rest run."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from trailweave.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return c


def cell(x):
    if isinstance(x, float):
        return "null" if math.isnan(x) else f"{x:.9g}"
    return "null" if x is None else str(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, con, name):
    df = catalog.queries()[name](spark, sf)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        cur = con.execute(SQL[name])
        assert found == rows([c[0] for c in cur.description], cur.fetchall())
    else:
        assert found[1]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(catalog.queries())
