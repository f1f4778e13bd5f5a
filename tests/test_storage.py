"""Plans that move nothing they need not, and what survives a run that is broken off."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tributary import catalog_storage
from tributary.functions import categories
from tributary.operators import candidates, pairs, sampling
from tributary.sources import files, ledger


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_of_ten_thousand_cities_has_no_exchange(spark, tmp_path):
    near = spark.range(10_000).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("yr"), F.col("id").cast("int").alias("from_city"))
    known = near.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20)))).select("yr", "from_city", ((F.col("from_city") * 7 + F.col("k") * 499) % 10_000).cast("int").alias("to_city"), (F.col("k") / 4).alias("w"))
    base = known.where("to_city % 3 > 0").withColumn("type_id", F.lit("t")).union(near.select("yr", "from_city", F.lit(-1), F.lit(0.0), F.lit("t"))).drop("w")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = catalog_storage.bucketed_join(base, known, str(tmp_path / "lookup-1"), 8)
        plan = _plan(joined)
        assert "Exchange" not in plan and "SortMergeJoin" in plan and plan.count("Bucketed: true") == 2
        got = joined.agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum((F.col("to_city") == -1).cast("int")).alias("unknown")).first()
        want = known.where("to_city % 3 > 0").agg(F.count("*").alias("n"), F.sum("w").alias("w")).first()
        assert (got["n"], got["w"], got["unknown"]) == (want["n"] + 20_000, want["w"], 20_000)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_negatives_are_cut_before_they_are_moved(spark):
    rows = spark.range(4000).select(F.lit(1).alias("yr"), (F.col("id") % 4).cast("string").alias("type_id"), F.lit(0).alias("from_city"), (F.col("id") / 4).cast("int").alias("to_city"), F.when(F.col("id") < 80, F.col("id").cast("int") % 20 + 1).otherwise(0).alias("rnk")).repartition(8)
    for df, n in ((sampling.exact_negatives(rows, 5), 5), (sampling.stratified_negatives(rows, [900, 901, 902], 2, 5), 7)):
        assert _plan(df).count("WindowGroupLimit") == 2
        df.collect()
        assert df.count() == 80 + 4 * n
    assert sampling.exact_negatives(rows.withColumn("rnk", F.lit(None).cast("int")), 5).count() == 20


def test_nearest_year_is_no_product(spark):
    have = spark.createDataFrame([(2000, 1, "a"), (2004, 1, "b"), (2004, 2, "c"), (2011, 1, "d")], "yr int, city_id int, v string")
    asked = spark.createDataFrame([(y,) for y in (1990, 2000, 2002, 2003, 2004, 2007, 2008, 2050, 2050)], "yr int")
    found = pairs.nearest_year(asked, have)
    assert "Cartesian" not in _plan(found) and "NestedLoop" not in _plan(found)
    got = {(r["yr"], r["own_yr"]) for r in found.collect()}
    assert got == {(1990, 2000), (2000, 2000), (2002, 2000), (2003, 2004), (2004, 2004), (2007, 2004), (2008, 2011), (2050, 2011)}
    assert found.where("yr = 2003").count() == 2 and pairs.nearest_year(asked, have.limit(0)).count() == 0


def test_roads_have_no_year(spark):
    base = spark.createDataFrame([(y, "q", 1, t) for y in (1, 2) for t in (2, 3)], "yr int, type_id string, from_city int, to_city int")
    kept = candidates.keep_reachable(base, spark.createDataFrame([(1, 3)], "from_city int, to_city int"))
    assert sorted((r["yr"], r["to_city"]) for r in kept.collect()) == [(1, 3), (2, 3)] and "NestedLoop" not in _plan(kept)


def test_an_export_goes_on_where_it_stopped(spark, tmp_path):
    df = spark.createDataFrame([(y, k, y * k) for y in (1, 2, 3, 4) for k in range(5)], "yr int, k int, v int")
    folder = str(tmp_path / "export")
    assert ledger.committed(spark, folder).count() == 0
    assert ledger.write_missing_years(df, folder, "k", most=2) == [1, 2]
    df.where("yr = 3 and k < 2").drop("yr").write.parquet(f"{folder}/data/yr=3")  # begun, never committed
    assert sorted(r["yr"] for r in ledger.read_years(spark, folder).select("yr").distinct().collect()) == [1, 2]
    before = {f: os.stat(f"{folder}/data/yr=1/{f}").st_mtime_ns for f in os.listdir(f"{folder}/data/yr=1")}
    assert ledger.write_missing_years(df, folder, "k") == [3, 4] and ledger.write_missing_years(df, folder, "k") == []
    assert before == {f: os.stat(f"{folder}/data/yr=1/{f}").st_mtime_ns for f in os.listdir(f"{folder}/data/yr=1")}
    assert sorted(map(tuple, ledger.read_years(spark, folder).select("yr", "k", "v").collect())) == sorted(map(tuple, df.collect()))
    lines = {r["what"]: (r["n_rows"], r["digest"]) for r in ledger.committed(spark, folder).collect()}
    assert {k: v[0] for k, v in lines.items()} == dict.fromkeys("1234", 5) and len(set(lines.values())) == 1


def test_codes_after_reload_are_the_same(spark, tmp_path):
    rows = spark.createDataFrame([("b", 10), ("a", 9), (None, 10), ("b", None)], "s string, n int")
    codes = categories.fit_codes(rows, ["s", "n"])
    again = categories.load_codes(spark, categories.save_codes(codes, str(tmp_path / "m")))
    new = spark.createDataFrame([("a", 9), ("z", 10), (None, None), ("b", 11)], "s string, n int")
    got = [[(r["s_code"], r["n_code"]) for r in categories.with_codes(new, c, ["s", "n"]).collect()] for c in (codes, again)]
    assert sorted(got[0]) == sorted(got[1]) == sorted([(0, 1), (-1, 0), (-1, -1), (1, -1)])  # values as texts, in order


def test_lines_of_files(spark, tmp_path):
    for yr, text in ((2000, '{"a": 1}\n\n{"a": 2'), (2001, '{"a": 3}\n   \nnot json\n{"a": "x"}\n'), (2003, "")):
        (tmp_path / f"rows_{yr}.jsonl").write_text(text)
    (tmp_path / "notes.txt").write_text('{"a": 9}')
    read = files.read_lines(spark, str(tmp_path), "rows_{yr}.jsonl", "a int").collect()
    assert sorted((r["yr"], r["c"] and r["c"]["a"], r["broken"]) for r in read if r["c"]) == [(2000, 1, None), (2001, 3, None)]
    assert sorted((r["yr"], r["broken"]) for r in read if r["broken"]) == [(2000, '{"a": 2'), (2001, "not json"), (2001, '{"a": "x"}')]
    there = files.years_there(spark, str(tmp_path), "rows_{yr}.jsonl")
    asked = spark.createDataFrame([(y,) for y in range(2000, 2005)], "yr int")
    assert sorted(r["yr"] for r in files.years_missing(asked, there).collect()) == [2002, 2003, 2004]


@pytest.mark.parametrize("n", [None, -1])
def test_all_negatives(spark, n):
    rows = spark.createDataFrame([(1, "q", k, k % 2) for k in range(10)], "yr int, type_id string, to_city int, rnk int")
    assert sampling.exact_negatives(rows, n).count() == 10


def test_a_table_written_anew_is_another_one(spark, tmp_path):
    import shutil

    import duckdb

    from tributary.plans.fixtures import TABLES, Fixtures

    for t in TABLES:
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    first = Fixtures(spark, str(tmp_path)).flows.agg(F.sum("n")).first()[0]
    assert Fixtures(spark, str(tmp_path)).flows.agg(F.sum("n")).first()[0] == first
    duckdb.sql(f"copy (select * from '/root/testdata/sf0.001/lineitem.parquet' where l_orderkey % 2 = 0) to '{tmp_path}/lineitem.parquet'")
    assert 0 < Fixtures(spark, str(tmp_path)).flows.agg(F.sum("n")).first()[0] < first


def test_columns_that_are_lacking(spark):
    from tributary.functions import features

    df = spark.createDataFrame([(1, None), (2, 5.0)], "a int, b double")
    assert sorted(map(tuple, features.lacking(df, "a", "b", "c").collect())) == [("a", 1, 0), ("b", 1, 1), ("c", 0, 2)]
    with pytest.raises(ValueError, match="c, d"):
        features.require(df, "a", "c", "d")
    assert features.feature_columns(df.withColumn("yr", F.lit(1))) == ["a", "b"]


def test_queries_without_a_positive_go(spark):
    df = spark.createDataFrame([(1, "q", 1, 0), (1, "q", 2, 1), (1, "r", 1, 0), (2, "q", 1, 0)], "yr int, type_id string, to_city int, label int")
    assert sorted(map(tuple, sampling.with_positive(df).collect())) == [(1, "q", 1, 0), (1, "q", 2, 1)]
