"""Composite pipelines: training, evaluation and export sets made of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions import features as feat
from tributary.functions import labels as lab
from tributary.functions.typeid import parse_lenient
from tributary.operators import candidates as cand
from tributary.operators import pairs as pr
from tributary.operators import ranking as rk
from tributary.operators import sampling as smp


def with_features(base: DataFrame, pairs: DataFrame, wages: list[str], vacancies: list[str]) -> DataFrame:
    """Person codes, pair features (0 for unknown pairs) and cross features of candidate rows.

    Sampling comes before this join, so only rows that stay become wide.
    """
    parsed = parse_lenient(base).withColumnRenamed("type_id_orig", "type_id")
    joined = pr.join_pairs(parsed, pairs)
    return feat.cross_features(joined, wages, vacancies)


def recall_training(base: DataFrame, pairs: DataFrame, wages: list[str], vacancies: list[str], hard: list[int], fraction: float = 0.6, n: int = 10, seed: int = 42) -> DataFrame:
    """Binary labels and weights: queries with a positive, a share of them, hard negatives and a
    share of the others, then features."""
    df = base.withColumns({"label": lab.binary(F.col("rnk")), "weight": lab.weight_recall(F.col("rnk"))})
    df = smp.keep_share(smp.sample_fraction(smp.with_positive(df), fraction, seed), hard, n, seed)
    return with_features(df, pairs, wages, vacancies)


def ranking_training(base: DataFrame, pairs: DataFrame, wages: list[str], vacancies: list[str], hard: list[int], fraction: float = 0.6, n: int = 10, seed: int = 42) -> DataFrame:
    """As recall_training(), with graded labels."""
    df = base.withColumns({"label": lab.graded_short(F.col("rnk")), "weight": F.lit(1)})
    df = smp.keep_share(smp.sample_fraction(smp.with_positive(df), fraction, seed), hard, n, seed)
    return with_features(df, pairs, wages, vacancies)


def stratified_training(base: DataFrame, pairs: DataFrame, wages: list[str], vacancies: list[str], hard: list[int], fraction: float = 0.8, n: int = 3, seed: int = 42) -> DataFrame:
    df = smp.stratified_negatives(smp.sample_fraction(base, fraction, seed), hard, n, n, seed)
    df = df.withColumns({"label": lab.binary(F.col("rnk")), "weight": lab.weight_steep(F.col("rnk"))})
    return with_features(df, pairs, wages, vacancies)


def recall_from_facts(long: DataFrame, cities: DataFrame, pairs: DataFrame, wages: list[str], vacancies: list[str], train: int, validation: int, n: int, seed: int = 42) -> DataFrame:
    """Train and validation rows straight from the truth: split, all known cities, n negatives."""
    queries = smp.split_train_validation(long.select("yr", "type_id", "from_city").distinct(), train, validation, seed)
    base = cand.keep_known(cand.expand(queries, cities), pairs)
    df = smp.exact_negatives(cand.with_truth(base, long), n, seed)
    df = df.withColumns({"label": lab.binary(F.col("rnk")), "weight": lab.weight_recall(F.col("rnk"))})
    return with_features(df, pairs, wages, vacancies)


def ranking_from_lists(lists: DataFrame, long: DataFrame, pairs: DataFrame, wages: list[str], vacancies: list[str], train: int, validation: int, seed: int = 42) -> DataFrame:
    """Graded rows of recalled and true destinations."""
    queries = smp.split_train_validation(long.select("yr", "type_id", "from_city").distinct(), train, validation, seed)
    recalled = cand.from_lists(queries.select("yr", "type_id", "from_city"), lists)
    pool = cand.keep_known(cand.hard_pool(recalled, long.join(recalled.select("yr", "type_id").distinct(), ["yr", "type_id"], "left_semi")), pairs)
    df = cand.with_truth(pool.join(queries.select("yr", "type_id", "split"), ["yr", "type_id"]), long)
    df = df.withColumns({"label": lab.graded(F.col("rnk")), "weight": F.lit(1)})
    return with_features(df, pairs, wages, vacancies)


def merged_training(base: DataFrame, pairs: DataFrame, wages: list[str], vacancies: list[str], n: int = 200, seed: int = 42) -> DataFrame:
    """All years' queries in one set, each with its positives and at most n negatives."""
    df = smp.exact_negatives(base, n, seed)
    df = df.withColumns({"label": lab.binary(F.col("rnk")), "weight": lab.weight_recall(F.col("rnk"))})
    return with_features(df, pairs, wages, vacancies)


def evaluation_set(base: DataFrame, pairs: DataFrame, wages: list[str], vacancies: list[str], n: int, seed: int = 42) -> DataFrame:
    df = smp.sample_count(base, n, seed).withColumn("label", lab.binary(F.col("rnk")))
    return with_features(df, pairs, wages, vacancies)


def transform(df: DataFrame, pairs: DataFrame, history: DataFrame | None, wages: list[str], vacancies: list[str], mode: str = "train", p: float = 0.1) -> DataFrame:
    """One plan for all years: required columns, placeholders when predicting, features, history
    (blanked for a share of the rows when training)."""
    df = feat.require(df, "yr", "type_id", "from_city", "to_city")
    if mode == "predict":
        df = feat.with_placeholders(df)
    df = with_features(df, pairs, wages, vacancies)
    if history is not None:
        known = history.select("yr", "type_id", "to_city", "hist_log_flow", "hist_share")
        df = df.join(known, ["yr", "type_id", "to_city"], "left").fillna(0.0, ["hist_log_flow", "hist_share"])
        if mode == "train":
            df = smp.drop_history(df, ["hist_log_flow", "hist_share"], p)
    return df


Scorer = Callable[[DataFrame], DataFrame]


def fixed_scorer(df: DataFrame) -> DataFrame:
    """A fixed linear formula over pair features, for results that any engine repeats."""
    formula = F.col("population_total_ratio") + 0.5 * F.col("gdp_per_capita_ratio") + F.col("migrant_stock_from_to") - F.col("geo_distance") / 1000
    return df.withColumn("score", F.round(formula, 9))


def batch_recall(queries: DataFrame, cities: DataFrame, pairs: DataFrame, wages: list[str], vacancies: list[str], scorer: Scorer, k: int = 100) -> DataFrame:
    """Every query's best k of all known cities; the pair features are joined once for all queries."""
    base = cand.keep_known(cand.expand(queries, cities), pairs)
    return rk.top_k(scorer(with_features(base, pairs, wages, vacancies)), k)


def rescore(queries: DataFrame, lists: DataFrame, pairs: DataFrame, wages: list[str], vacancies: list[str], scorer: Scorer, k: int = 40) -> DataFrame:
    """Given lists in the order of another score, cut to k."""
    return rk.top_k(scorer(with_features(cand.from_lists(queries, lists), pairs, wages, vacancies)), k)


def predict(requests: DataFrame, cities: DataFrame, pairs: DataFrame, wages: list[str], vacancies: list[str], scorer: Scorer, k: int = 10) -> DataFrame:
    """Answers to requests (idx, yr, type_id, origin or null), one row a place; a bad type id has none.

    The origin itself stays out; a six-part id takes it from `origin`.
    """
    from tributary.functions.cities import with_names
    from tributary.functions.typeid import parse

    good = parse(requests, origin="origin").where("parse_ok").select("idx", "yr", "type_id", "from_city")
    scored = scorer(with_features(cand.expand(good, cities), pairs, wages, vacancies))
    return with_names(rk.top_k(scored, k, keys=("idx",)), cities).select("idx", "pos", "to_city", "city_name", "score")
