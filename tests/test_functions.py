"""Small frames worked out by hand: nulls, ties, bad ids, empty groups."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from tributary.functions import cities, features, typeid
from tributary.operators import candidates, history, metrics, pairs, ranking, sampling
from tributary.operators.numbering import numbered
from tributary.plans import learn
from tributary.sources import tables


def test_city_texts(spark):
    df = spark.createDataFrame([("1100",), (" 1100 ",), ("北京(1100)",), ("x12y34",), ("",), (None,), ("abc",)], "t string")
    assert [r[0] for r in df.select(cities.city_id_robust(F.col("t"))).collect()] == [1100, 1100, 1100, 34, 0, 0, 0]
    assert [r[0] for r in df.select(cities.safe_int(F.col("t"))).collect()][4:] == [-1, -1, -1]


def test_type_ids(spark):
    rows = [("M_20_EduHi_Agri_IncH_Split_1100", None), ("M_20_EduHi_Agri_IncH_Split", "7"), ("M_20_EduHi_Agri_IncH_Split", None), ("M_20_EduHi_Agri_IncH", "7"), ("M_99_EduHi_Agri_IncH_Split_1100", None), (None, None)]
    got = typeid.parse(spark.createDataFrame(rows, "type_id string, origin string"), origin="origin").collect()
    assert [r["parse_ok"] for r in got] == [True, True, False, False, False, False]
    assert (got[0]["from_city"], got[1]["from_city"], got[4]["age_group"]) == (1100, 7, None)
    with pytest.raises(Exception, match="bad type id"):
        typeid.parse_strict(spark.createDataFrame([("x",)], "type_id string")).collect()


def test_every_person_round_trip(spark):
    every = typeid.every_person(spark.createDataFrame([(1100,)], "from_city int"))
    again = typeid.parse(every.select("type_id")).withColumn("again", typeid.encoded())
    assert every.count() == typeid.person_count() == 1200
    assert again.where("parse_ok and again = type_id").count() == 1200


@pytest.mark.parametrize(("to", "frm", "want"), [(1.0, 0.0, 100.0), (1.0, 1e-10, 100.0), (1.0, -1.0, 0.01), (1.0, math.nan, 100.0), (1.0, None, 100.0), (0.0, 5.0, 0.01), (1e300, 1.0, 100.0), (3.0, 2.0, 1.5), (math.inf, 1.0, 0.01)])
def test_safe_ratio(spark, to, frm, want):
    df = spark.createDataFrame([(to, frm)], "t double, f double")
    assert df.select(features.safe_ratio(F.col("t"), F.col("f"))).first()[0] == pytest.approx(want)


def test_candidate_lists_of_both_shapes(spark):
    lines = spark.createDataFrame([(1, '{"a":[3,1,3]}'), (1, '{"b":{"top_cities":[5,6]}}'), (1, '{"c":[]}')], "yr int, value string")
    assert {r["type_id"]: list(r["cities"]) for r in tables.candidate_lists(lines, 2).collect()} == {"a": [3, 1], "b": [5, 6], "c": []}


def _ranks(spark, rows):
    return spark.createDataFrame(rows, "yr int, type_id string, to_city int, pos int")


def test_metrics_by_hand(spark):
    truth = spark.createDataFrame([(1, "a", 10, 1), (1, "a", 30, 2), (1, "b", 10, 1)], "yr int, type_id string, to_city int, rnk int")
    got = {r["type_id"]: r for r in metrics.judged(_ranks(spark, [(1, "a", 10, 1), (1, "a", 20, 2), (1, "a", 30, 3), (1, "c", 10, 1)]), truth, (3,)).collect()}
    assert got["a"]["ap_3"] == pytest.approx((1 + 2 / 3) / 2)
    assert (got["a"]["hits_3"], got["a"]["mrr"], got["b"]["hits_3"], got["b"]["mrr"], got["b"]["ndcg_3"]) == (2, 1.0, 0, 0.0, 0.0)
    assert "c" not in got
    ideal = metrics.judged(_ranks(spark, [(1, "a", 10, 1), (1, "a", 30, 2)]), truth, (3,)).where("type_id = 'a'").first()
    assert ideal["ndcg_3"] == pytest.approx(1.0)


def test_ties_go_to_the_smaller_city(spark):
    df = spark.createDataFrame([(1, "a", 7, 1.0), (1, "a", 3, 1.0), (1, "a", 5, 2.0)], "yr int, type_id string, to_city int, score double")
    assert [r["to_city"] for r in ranking.top_k(df, 2).orderBy("pos").collect()] == [5, 3]


def test_nearest_year_prefers_the_earlier(spark):
    have = spark.createDataFrame([(2000, 1), (2004, 1)], "yr int, city_id int")
    assert pairs.nearest_year(spark.createDataFrame([(2002,)], "yr int"), have).first()["own_yr"] == 2000


def test_samples(spark):
    df = spark.createDataFrame([(1, f"q{q}", 1, c, int(c < 2)) for q in range(20) for c in range(6)], "yr int, type_id string, from_city int, to_city int, rnk int")
    split = sampling.split_train_validation(df, 5, 4).select("type_id", "split").distinct().collect()
    train, val = ({r[0] for r in split if r[1] == s} for s in ("train", "val"))
    assert (len(train), len(val), train & val) == (5, 4, set())
    assert sampling.exact_negatives(df, 2).where("rnk > 0").count() == 40
    assert sampling.exact_negatives(df, 2).count() == 80
    assert sampling.exact_negatives(df, None).count() == sampling.exact_negatives(df, 99).count() == 120
    assert sampling.sample_fraction(df, 0.0001, least=1).select("type_id").distinct().count() == 1
    assert sampling.sample_count(df.repartition(7), 3).select("type_id").distinct().orderBy("type_id").collect() == sampling.sample_count(df, 3).select("type_id").distinct().orderBy("type_id").collect()


def test_years(spark, tmp_path):
    df = spark.createDataFrame([(1, 2), (2, 3)], "yr int, v int")
    with pytest.raises(FileNotFoundError):
        tables.years_present(df, [1, 5], "raise")
    assert tables.years_present(df, [1, 5]).count() == 1
    tables.write_years(df, str(tmp_path / "t"))
    tables.write_years(df.where("yr = 2").withColumn("v", F.lit(9)), str(tmp_path / "t"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("yr", "v").collect()} == {(1, 2), (2, 9)}


def test_history_and_candidates_of_empty_frames(spark):
    flows = spark.createDataFrame([], "yr int, type_id string, from_city int, to_city int, n long, rnk int, label int")
    assert history.with_history(flows).count() == 0
    assert candidates.hard_pool(flows, flows).count() == 0


def test_numbers_are_exact_with_one_heavy_bucket(spark):
    rows = [(g, f"{'aaa' if k < 700 else 'b' + str(k % 7)}{k:04d}") for g in (1, 2) for k in range(1000)]
    df = spark.createDataFrame(rows, "g int, id string").repartition(7)
    got = numbered(df, ("g",), F.substring("id", 1, 3), "id", into="k", total="n").collect()
    for g in (1, 2):
        own = sorted((r["k"], r["id"]) for r in got if r["g"] == g)
        assert [k for k, _ in own] == list(range(1, 1001)) and [i for _, i in own] == sorted(i for _, i in own)
        assert {r["n"] for r in got} == {1000}
    everything = sorted((r["k"], r["g"], r["id"]) for r in numbered(df, (), F.struct("g", F.substring("id", 1, 3)), "id", into="k").collect())
    assert [x[1:] for x in everything] == sorted(x[1:] for x in everything)
    plan = numbered(df, ("g",), F.substring("id", 1, 3), "id")._jdf.queryExecution().toString()
    assert re.search(r"row_number\(\) windowspecdefinition\(g#\d+, _bucket#", plan)  # rows are sorted by bucket, not by group
    assert numbered(spark.createDataFrame([], "g int, id string"), ("g",), F.substring("id", 1, 3), "id").count() == 0


def test_dense_query_numbers(spark):
    df = spark.createDataFrame([(y, f"M_20_EduLo_{a}_IncL_Unit_{c}") for y in (2001, 1999) for a in ("Mfg", "Agri") for c in (9, 1000, 30)] * 2, "yr int, type_id string")
    got = sorted((r["qid"], r["yr"], r["type_id"]) for r in ranking.dense_query_numbers(df).distinct().collect())
    assert [q for q, _, _ in got] == list(range(12)) and [x[1:] for x in got] == sorted(x[1:] for x in got)
    other = ranking.query_numbers(df).select("yr", "type_id", "qid").distinct()
    assert other.count() == other.select("qid").distinct().count() == 12


def test_names_of_repeated_ids(spark):
    nodes = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "d")], "city_id int, city_name string")
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "to_city int")
    assert sorted((r["to_city"] or 0, r["city_name"]) for r in cities.with_names(df, nodes).collect()) == [(0, "Unknown"), (1, "a"), (2, "c"), (3, "Unknown")]


def test_pairs_of_a_year_over_salts(spark):
    have = spark.createDataFrame([(y, c, float(c)) for y in (1, 2) for c in range(40)], "yr int, city_id int, v double")
    got = pairs.city_pairs(have)
    assert got.count() == got.select("yr", "from_city", "to_city").distinct().count() == 2 * 40 * 39
    assert set(got.columns) == {"yr", "from_city", "to_city", "from_v", "to_v"}


def test_last_month(spark):
    facts = spark.createDataFrame([(1, "a", 3, 1), (1, "a", 11, 2), (1, "b", 2, 3), (2, "a", 1, 4)], "yr int, type_id string, month int, v int")
    assert sorted(r["v"] for r in tables.latest_month(facts).collect()) == [2, 3, 4]


def test_lines_and_reset(spark, tmp_path):
    lines = spark.createDataFrame([(1, '{"a":[1]}'), (2, '{"b":[2]}')], "yr int, value string")
    tables.write_lines(lines, str(tmp_path / "lines"))
    assert sorted(map(tuple, tables.read_lines(spark, str(tmp_path / "lines")).collect())) == [(1, '{"a":[1]}'), (2, '{"b":[2]}')]
    df = spark.createDataFrame([(1, 2), (2, 3)], "yr int, v int")
    tables.write_years(df, str(tmp_path / "t"))
    tables.write_years(df.where("yr = 2"), str(tmp_path / "t"), reset=True)
    assert [r["yr"] for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [2]


def test_prefixes():
    assert learn.prefix_length(2000) == 500 and learn.prefix_length(200) == 150 and learn.prefix_length(90) == 90


def test_pair_features_of_holes(spark):
    """Numbers that are missing or not finite count as 0; a divisor next to 0 is bounded."""
    from tributary.operators import pairs

    own = "yr int, city_id int, tier int, population_total double, gdp_per_capita double, rent double"
    cities = spark.createDataFrame([(2000, 1100, 1, 9.0, 2.0, None), (2000, 1101, 3, None, float("nan"), 4.0), (2001, 1100, 1, 1.0, 1.0, 1.0)], own)
    edges = spark.createDataFrame([(1100, 1101, 5.0, None)], "source_id int, target_id int, w_geo double, w_dialect double")
    migrants = spark.createDataFrame([(2000, 1101, {"1100": 0.25})], "yr int, to_city int, stock map<string,double>")
    got = {(r["from_city"], r["to_city"]): r for r in pairs.pair_features(cities, edges, migrants, ["gdp_per_capita", "rent"], ["rent"]).collect()}
    assert set(got) == {(1100, 1101), (1101, 1100)}
    there, back = got[1100, 1101], got[1101, 1100]
    assert (there["gdp_per_capita_ratio"], there["rent_ratio"], there["rent_diff"], there["tier_diff"]) == (0.01, 100.0, 4.0, 2)
    assert (back["gdp_per_capita_ratio"], back["rent_ratio"], back["rent_diff"]) == (100.0, 0.01, -4.0)
    assert (there["migrant_stock_from_to"], there["geo_distance"], there["dialect_distance"], there["is_same_province"]) == (0.25, 5.0, 0.0, 1)
    assert (back["migrant_stock_from_to"], back["geo_distance"], there["to_population_log"]) == (0.0, 0.0, 0.0)
    assert there["from_population_log"] == pytest.approx(2.302585, abs=1e-6)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
