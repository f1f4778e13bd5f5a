"""Every query of the subpackage that has SQL against DuckDB, on the driver's tables and on awkward rows."""

from __future__ import annotations

import duckdb
import pytest

from tests.llm.test_operators import SCHEMA, _texts
from tributary.llm.queries import ORACLES, QUERIES


def _same(spark, name, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings")[: 1 if "tmp" in str(sf_dir) else 2]:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet{'/*.parquet' if 'tmp' in str(sf_dir) else ''}')")
    df = QUERIES[name](spark, str(sf_dir))
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(dict(zip(rel.columns, r))[c] for c in columns) for r in rel.fetchall()), key=repr)
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    assert len(got) == len(want) and not wrong, wrong[:3]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    _same(spark, name, "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"op12_hard_negatives"}))  # its own tests have odd vectors
def test_query_matches_sql_on_awkward_rows(spark, name, tmp_path):
    """Null, empty and blank texts, a null source, copies; doc_ids are keys here, as the SQL takes them."""
    rows = [r for r in _texts() if r[0] is not None]
    spark.createDataFrame(rows[:-1], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    _same(spark, name, tmp_path)
