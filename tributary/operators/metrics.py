"""Recall, hits, precision, AP, MRR and NDCG of ranked lists against the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.labels import gain
from tributary.operators.ranking import QUERY


def judged(ranks: DataFrame, truth: DataFrame, k_list: tuple[int, ...] = (1, 5, 10, 20), denominator: str = "truth", best: int | None = None) -> DataFrame:
    """All metrics of each query with a truth, in one pass over its ranked rows.

    ranks: QUERY, to_city, pos; truth: QUERY, to_city, rnk (`best` limits it to its first ranks).
    denominator: "truth" divides recall by the truth's size, "least" by min(k, size). A query that
    has a truth but no ranked row scores 0.
    """
    if denominator not in ("truth", "least"):
        raise ValueError("denominator is truth or least")
    truth = truth.where(F.col("rnk") <= best) if best else truth
    place = F.row_number().over(Window.partitionBy(*QUERY).orderBy("rnk", "to_city"))
    truth = truth.select(*QUERY, "to_city", "rnk", place.alias("ideal_pos"))
    both = truth.join(ranks.select(*QUERY, "to_city", "pos"), [*QUERY, "to_city"], "left")
    hits = Window.partitionBy(*QUERY).orderBy(F.col("pos").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("so_far", F.count("pos").over(hits)).withColumn("gain", gain(F.col("rnk")))
    within = lambda p, k: F.coalesce(F.col(p) <= k, F.lit(False))
    out = [F.count("*").alias("gt_size"), F.coalesce(F.min("pos"), F.lit(0)).alias("first_hit")]
    for k in k_list:
        out.append(F.sum(F.when(within("pos", k), 1).otherwise(0)).alias(f"hits_{k}"))
        out.append(F.sum(F.when(within("pos", k), F.col("so_far") / F.col("pos")).otherwise(0.0)).alias(f"ap_{k}"))
        for name, p in (("dcg", "pos"), ("idcg", "ideal_pos")):
            out.append(F.sum(F.when(within(p, k), F.col("gain") / F.log2(F.col(p) + 1)).otherwise(0.0)).alias(f"{name}_{k}"))
    q = both.groupBy(*QUERY).agg(*out)
    most = max(k_list)
    q = q.withColumn("mrr", F.when(F.col("first_hit").between(1, most), 1 / F.col("first_hit")).otherwise(0.0))
    for k in k_list:
        least = F.least(F.lit(k), F.col("gt_size"))
        q = q.withColumn(f"recall_{k}", F.col(f"hits_{k}") / (F.col("gt_size") if denominator == "truth" else least))
        q = q.withColumn(f"precision_{k}", F.col(f"hits_{k}") / k).withColumn(f"ap_{k}", F.col(f"ap_{k}") / least)
        q = q.withColumn(f"ndcg_{k}", F.when(F.col(f"idcg_{k}") > 0, F.col(f"dcg_{k}") / F.col(f"idcg_{k}")).otherwise(0.0))
    return q.drop("first_hit", *[f"{n}_{k}" for k in k_list for n in ("dcg", "idcg")])


def by_year(per_query: DataFrame, *metrics: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Means per year and, as year null, over all queries; in one job."""
    means = [F.avg(m).alias(m) for m in metrics]
    sets = [[*keys, "yr"], [*keys]]
    return per_query.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys], F.col("yr")).agg(F.count("*").alias("n_queries"), F.avg("gt_size").alias("mean_gt"), *means)


def unweighted(yearly: DataFrame, *metrics: str) -> DataFrame:
    """Mean of the yearly means."""
    return yearly.where("yr is not null").agg(F.count("*").alias("n_years"), *[F.avg(m).alias(m) for m in metrics])


def percent_hits(per_query: DataFrame, k: int = 20) -> DataFrame:
    """Mean hits of k as a percentage of k."""
    return per_query.groupBy("yr").agg((F.avg(f"hits_{k}") / k * 100).alias("percent"))


def group_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy(*QUERY).agg(F.count("*").alias("size"))


def balance_weight(df: DataFrame) -> DataFrame:
    """Negatives per positive (1 positive at least)."""
    pos = F.sum(F.when(F.col("label") == 1, 1).otherwise(0))
    return df.groupBy("yr").agg(((F.count("*") - pos) / F.greatest(pos, F.lit(1))).alias("pos_weight"))


def expansion(rows: DataFrame, negatives: int, full: int) -> DataFrame:
    """Rows that `negatives` a query will give, against all candidates."""
    n = F.count("*")
    return rows.groupBy("yr").agg(n.alias("queries"), (n * (20 + negatives)).alias("rows"), (F.lit(20 + negatives) / full).alias("share"))
