"""Every query with SQL against DuckDB on the smallest driver tables."""

from __future__ import annotations

import duckdb
import pytest

from tributary import catalog, catalog_learning, catalog_storage  # noqa: F401

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(catalog.ORACLES[name])
    want = sorted((tuple(dict(zip(rel.columns, r))[c] for c in columns) for r in rel.fetchall()), key=repr)
    assert got == want



def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
