"""Learning on candidate rows with MLlib: recall by boosted trees, a linear order by weighted pairs. plans/boosting.py
has the trainer that stops, resumes and ranks by lambdas."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.labels import graded, listed_gain
from tributary.operators.metrics import judged
from tributary.operators.ranking import QUERY, ranked

_SCORES = ("features", "rawPrediction", "probability", "prediction")


def fit_recall(train: DataFrame, features: list[str], rounds: int = 20, seed: int = 42, checkpoint: int = 10) -> PipelineModel:
    """Boosted trees on `label` and `weight`."""
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=4, seed=seed, checkpointInterval=checkpoint)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), trees]).fit(train)


def score(model: PipelineModel, df: DataFrame, into: str = "score") -> DataFrame:
    out = model.transform(df)
    return out.withColumn(into, vector_to_array("probability")[1]).drop(*_SCORES)


def prefix_length(trees: int, share: float = 0.25, least: int = 150) -> int:
    """How many of the first trees to score with: a share of them, `least` at least."""
    return min(trees, max(int(trees * share), least))


def score_stumps(df: DataFrame, stumps: list[tuple[str, float, float, float]], first: int | None = None, into: str = "score") -> DataFrame:
    """The sum over the first trees of an exported model of one split each: (feature, threshold, value up
    to it, value above it)."""
    total = F.lit(0.0)
    for feature, threshold, low, high in stumps[:first]:
        total = total + F.when(F.col(feature) <= threshold, low).otherwise(high)
    return df.withColumn(into, total)


def top_features(values: DataFrame, n: int = 20) -> DataFrame:
    """(feature, importance), the n greatest."""
    return values.orderBy(F.desc("importance"), "feature").limit(n)


def preference_pairs(df: DataFrame, features: list[str], best: int = 20) -> DataFrame:
    """Within a query, each relevant candidate against each less relevant one: feature differences
    weighted by the gain that swapping them would move. At most `best` relevant ones a query."""
    rel = df.withColumn("rel", graded(F.col("rnk"))).withColumn("gain", listed_gain(F.ceil(F.col("rel") * 11 / 20)))
    a = rel.where("rel > 0").select(*QUERY, F.col("rel").alias("rel_a"), F.col("gain").alias("gain_a"), F.col("rnk").alias("rnk_a"), *[F.col(f).alias(f"a_{f}") for f in features]).where(F.col("rnk_a") <= best)
    b = rel.select(*QUERY, F.col("rel").alias("rel_b"), F.col("gain").alias("gain_b"), F.col("rnk").alias("rnk_b"), *[F.col(f).alias(f"b_{f}") for f in features])
    at = lambda r: 1 / F.log2(1 + F.when(F.col(r) > 0, F.col(r)).otherwise(best + 1))
    pairs = a.join(b, list(QUERY)).where("rel_a > rel_b")
    weight = F.abs((F.col("gain_a") - F.col("gain_b")) * (at("rnk_a") - at("rnk_b")))
    return pairs.select(*QUERY, weight.alias("weight"), *[(F.col(f"a_{f}") - F.col(f"b_{f}")).alias(f) for f in features])


def fit_ranking(df: DataFrame, features: list[str], rounds: int = 50) -> PipelineModel:
    """A linear order from preference pairs, every other one turned round as a negative."""
    pairs = preference_pairs(df, features)
    turned = F.pmod(F.xxhash64(*QUERY, *features), F.lit(2)) == 0
    signed = pairs.select("weight", *[F.when(turned, -F.col(f)).otherwise(F.col(f)).alias(f) for f in features], (~turned).cast("double").alias("label")).where("weight > 0")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=rounds, fitIntercept=False, regParam=1e-3)]).fit(signed)


def validation_recall(scored: DataFrame, truth: DataFrame, k_list: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    return judged(ranked(scored), truth, k_list, "least").agg(*[F.avg(f"recall_{k}").alias(f"recall_{k}") for k in k_list])
