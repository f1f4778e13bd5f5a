"""The trainer: stopping, resuming, ranking quality, and trees as a table."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tributary import catalog_learning
from tributary.plans import boosting, learn
from tributary.plans.fixtures import Fixtures
from tributary.sources import ledger

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(3), []
    for q in range(60):
        for city in range(20):
            a, b, c = rng.random(), rng.randrange(5), rng.random()
            score = 3 * a - (b == 2) + rng.gauss(0, 0.3)
            out.append((1999 if q % 3 == 0 else 1998, f"q{q}", city, score, float(a), b if rng.random() < 0.9 else None, c, q % 3 == 0))
    df = spark.createDataFrame(out, "yr int, type_id string, to_city int, s double, a double, b int, c double, held boolean")
    place = F.expr("row_number() over (partition by yr, type_id order by s desc)")
    df = df.withColumn("p", place).select("*", F.when(F.col("p") <= 8, F.col("p")).otherwise(0).alias("rnk"), (F.col("p") <= 5).cast("int").alias("label"), F.lit(1).alias("weight"))
    return df.drop("s", "p").cache()


def _truth(rows):
    return rows.where("rnk > 0").select("yr", "type_id", "to_city", "rnk")


def test_training_broken_off_and_resumed_is_training_in_one_go(spark, rows, tmp_path):
    measure = boosting.recall_at(_truth(rows), 5)
    how = {"depth": 2, "rate": 0.3, "measure": measure}
    whole = boosting.fit(rows, FEATURES, boosting.binary, 5, folder=str(tmp_path / "whole"), **how)
    parts = str(tmp_path / "parts")
    boosting.fit(rows.repartition(7), FEATURES, boosting.binary, 3, folder=parts, every=2, **how)  # commits round 2 only
    spark.range(1).write.parquet(f"{parts}/model-4")  # begun, never committed
    assert [r["what"] for r in ledger.committed(spark, parts).collect()] == ["2"]
    resumed = boosting.fit(rows.where("false"), FEATURES, boosting.binary, 5, folder=parts, every=2, **how)  # all it needs is in the folder
    assert resumed == whole and whole.rounds == 5
    again = boosting.load(spark, whole.save(spark, str(tmp_path / "model")))
    assert again == whole


def test_rounds_after_the_stop_are_not_grown(rows):
    said = iter([0.1, 0.4, 0.4, 0.3, 0.9])
    model = boosting.fit(rows, FEATURES, boosting.binary, 5, depth=1, measure=lambda held: next(said), patience=2)
    assert (model.rounds, model.best, model.history) == (4, 2, [0.1, 0.4, 0.4, 0.3])
    assert {n[0] for n in model.nodes} == {0, 1, 2, 3} and next(said) == 0.9
    scored = rows.fillna(0, FEATURES).select(model.column().alias("best"), model.column(2).alias("two"))
    assert scored.where("best <> two").count() == 0


def test_the_column_scores_as_the_trainer_does(spark, rows, tmp_path):
    folder = str(tmp_path / "run")
    model = boosting.fit(rows, FEATURES, boosting.lambdas(), 2, folder=folder, every=2)
    own = spark.read.parquet(f"{folder}/scores-2").withColumnRenamed("score", "trained")
    both = model.score(rows.fillna(0, FEATURES)).join(own.select("yr", "type_id", "to_city", "trained"), ["yr", "type_id", "to_city"])
    assert both.count() == 1200 and both.where("score <> trained").count() == 0
    better = boosting.ndcg_at(_truth(rows))
    assert better(model.score(rows.fillna(0, FEATURES)).where("held")) > better(rows.withColumn("score", F.rand(1)).where("held")) + 0.1


def test_lambdas_by_hand(spark):
    """Two rows of a query: one pair, whose pull is the NDCG that changing places moves times the chance of being wrong."""
    df = spark.createDataFrame([(1, "q", 1, 0, 2.0), (1, "q", 2, 1, 1.0), (1, "alone", 1, 1, 0.0)], "yr int, type_id string, to_city int, rnk int, score double")
    got = {(r["type_id"], r["to_city"]): (r["g"], r["h"]) for r in boosting.lambdas()(df).collect()}
    import math

    chance = 1 / (1 + math.exp(1.0 - 2.0))
    moved = 50 * (1 - 1 / math.log2(3)) / 50
    pull, bend = round(moved * chance * boosting.UNIT), round(moved * chance * (1 - chance) * boosting.UNIT)
    assert got == {("q", 2): (pull, bend), ("q", 1): (-pull, bend), ("alone", 1): (0, 0)}


def test_mllib_trees_as_a_table(rows, tmp_path):
    model = learn.fit_recall(rows.fillna(0).withColumn("label", F.col("label").cast("double")), FEATURES, 4).stages
    table = boosting.from_mllib(model[-1], FEATURES, str(tmp_path / "m"))
    scored = model[-1].transform(model[0].transform(rows.fillna(0)))
    assert table.rounds == 4
    for first in (2, 4):
        own = table.score(scored, first, "own")
        margin = vector_to_array("rawPrediction")[1] if first == 4 else sum((_tree(model[-1], k, own) for k in range(2)), F.lit(0.0))
        assert own.where(F.abs(F.col("own") - margin) > 1e-9).count() == 0


def _tree(model, k, df):
    from pyspark.sql.functions import pandas_udf

    tree, weight = model.trees[k], model.treeWeights[k]
    points = df.select("a", "b", "c").distinct().collect()
    from pyspark.ml.linalg import Vectors

    known = {tuple(map(float, p)): tree.predict(Vectors.dense(*map(float, p))) * weight for p in points}

    @pandas_udf("double")
    def said(a, b, c):
        import pandas as pd

        return pd.Series([known[tuple(map(float, p))] for p in zip(a, b, c)])

    return said("a", "b", "c")


def test_lambdas_rank_better_than_a_linear_order_and_last_year(spark):
    """NDCG@10 on the year 2000, trained on earlier ones only."""
    fx = Fixtures(spark, "/root/testdata/sf0.01")
    rows = catalog_learning.learning_rows(fx).cache()
    train, new = rows.where("yr < 2000"), rows.where("yr = 2000")
    ndcg = boosting.ndcg_at(fx.truth.where("yr = 2000"))
    trees = boosting.fit(train, catalog_learning.FEATURES, boosting.lambdas(), 10, rate=0.2, bins=32)
    linear = learn.fit_ranking(train.where("not held"), catalog_learning.FEATURES, 10)
    reached = ndcg(trees.score(new))
    assert reached > ndcg(learn.score(linear, new)) and reached > ndcg(new.withColumn("score", F.col("hist_log_flow")))
    rows.unpersist()
