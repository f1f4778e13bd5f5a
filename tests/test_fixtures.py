"""The fixtures as Spark makes them: lines of orders joined once, with the results of the SQL on odd tables too."""

from __future__ import annotations

import duckdb
import pytest

from tributary.plans import fixtures
from tributary.plans.fixtures import TABLES, WITH, Fixtures

FROM = "/root/testdata/sf0.001"
#: Keys that stand twice, that nothing has, and that are null, in every table.
ODD = {
    "nation": "select * from t union all select n_nationkey, 'TWIN', n_regionkey + 1 from t where n_nationkey = 3",
    "customer": """select * from t where c_custkey % 11 <> 1 union all select * replace (5 as c_nationkey) from t where c_custkey % 17 = 3
      union all select * replace (null as c_custkey) from t where c_custkey = 7 union all select * replace (99 as c_nationkey) from t where c_custkey % 23 = 5""",
    "supplier": """select * from t where s_suppkey % 5 <> 2 union all select * replace (3 as s_nationkey) from t where s_suppkey % 4 = 1
      union all select * replace (null as s_suppkey) from t where s_suppkey = 4""",
    "part": "select * from t where p_partkey % 9 <> 2 union all select * from t where p_partkey % 13 = 1 union all select * replace (null as p_partkey) from t where p_partkey = 5",
    "orders": """select * from t union all select * from t where o_orderkey % 50 = 3 union all select * replace (null as o_orderkey) from t where o_orderkey = 9
      union all select * replace (null as o_custkey, 77777777 as o_orderkey) from t where o_orderkey = 10 union all select * replace (null as o_orderdate, 88888888 as o_orderkey) from t where o_orderkey = 11""",
    "lineitem": """select * from t union all select * replace (null as l_orderkey, null as l_suppkey) from t where l_orderkey = 12
      union all select * replace (99999999 as l_orderkey) from t where l_orderkey = 13 union all select * replace (null as l_suppkey, null as l_partkey) from t where l_orderkey = 14
      union all select * replace (77777777 as l_orderkey) from t where l_orderkey = 15 union all select * replace (88888888 as l_orderkey, null as l_shipdate, null as l_returnflag, null as l_tax) from t where l_orderkey % 40 = 16""",
}


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    for t in TABLES:
        con.execute(f"copy (with t as (select * from '{FROM}/{t}.parquet') {ODD[t]}) to '{folder}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("sent", [fixtures.SUPPLIERS_SENT, 0])
@pytest.mark.parametrize("name", ["fx_flows", "fx_sector", "fx_city_more"])
def test_fixtures_over_lines_are_their_sql_on_odd_tables(spark, odd, monkeypatch, name, sent):
    """Also where suppliers are too many to be sent."""
    monkeypatch.setattr(fixtures, "SUPPLIERS_SENT", sent)
    monkeypatch.setattr(fixtures, "_staged", {})
    folder, con = odd
    df = getattr(Fixtures(spark, folder), name.removeprefix("fx_"))
    rel = con.sql(f"{WITH} select {', '.join(df.columns)} from {name}")
    order = lambda rows: sorted(rows, key=lambda r: [repr(v) if not isinstance(v, float) else f"{v:.3f}" for v in r])
    got, want = order(map(tuple, df.collect())), order(rel.fetchall())
    assert len(got) == len(want) > 20
    for g, w in zip(got, want):
        assert [x if not isinstance(x, float) else pytest.approx(x, abs=2e-6) for x in w] == list(g)


def test_lines_are_dealt_once_for_all_fixtures(spark, odd, monkeypatch):
    """One shuffle of the lines by order for flows, sectors and attributes; only sectors deal again, what they need by part."""
    monkeypatch.setattr(fixtures, "_staged", {})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fx = Fixtures(spark, odd[0])
        made = {n: fx._derived(n) for n in ("fx_lines", "fx_flows", "fx_sector", "fx_city_more")}
        reads = {n: sum(f.endswith("/lineitem.parquet") for f in df.inputFiles()) for n, df in made.items()}
        deals = {n: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(l_") for n, df in made.items()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert reads == {"fx_lines": 1, "fx_flows": 0, "fx_sector": 0, "fx_city_more": 0}
    assert deals == {"fx_lines": 1, "fx_flows": 0, "fx_sector": 1, "fx_city_more": 0}


def test_city_attributes_over_orders_are_their_sql_on_odd_tables(spark, odd, monkeypatch):
    test_fixtures_over_lines_are_their_sql_on_odd_tables(spark, odd, monkeypatch, "fx_city_attr", fixtures.SUPPLIERS_SENT)


def test_orders_are_dealt_once_for_attributes_and_lines_narrow(spark, odd, monkeypatch):
    """Both fixtures of cities count from one join of orders and customers; a line's few-valued columns are dealt as one number."""
    monkeypatch.setattr(fixtures, "_staged", {})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fx = Fixtures(spark, odd[0])
        reads = {n: sum(f.endswith("/orders.parquet") for f in fx._derived(n).inputFiles()) for n in ("fx_city_attr", "fx_city_more")}
        plan = fx._derived("fx_lines")._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert reads == {"fx_city_attr": 0, "fx_city_more": 0}
    dealt = plan[next(i for i, line in enumerate(plan) if "Exchange hashpartitioning(l_orderkey" in line) + 1]
    assert "AS marks#" in dealt and "AS returned#" not in dealt and "AS ship_day#" not in dealt
