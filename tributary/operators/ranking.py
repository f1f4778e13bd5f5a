"""Ranked lists per query; ties always go to the smaller city."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators.numbering import numbered

QUERY = ("yr", "type_id")


def ranked(df: DataFrame, score: str = "score", into: str = "pos", keys: tuple[str, ...] = QUERY) -> DataFrame:
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), "to_city")))


def top_k(df: DataFrame, k: int, score: str = "score", keys: tuple[str, ...] = QUERY) -> DataFrame:
    """The plan limits each query's rows before the shuffle (WindowGroupLimit)."""
    return ranked(df, score, keys=keys).where(F.col("pos") <= k)


def as_lists(ranks: DataFrame, keys: tuple[str, ...] = QUERY) -> DataFrame:
    """One row a query, its cities in order of pos (bounded by the lists' k)."""
    return ranks.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "to_city"))), lambda s: s["to_city"]).alias("cities"))


def cascade(df: DataFrame, recall_k: int = 80, rank_k: tuple[int, ...] = (20, 40), first: str = "score", second: str = "score2") -> DataFrame:
    """Top recall_k by one score, those by another; adds recall_pos and rank_pos."""
    recalled = ranked(df, first, "recall_pos").where(F.col("recall_pos") <= recall_k)
    return ranked(recalled, second, "rank_pos").where(F.col("rank_pos") <= max(rank_k))


def truth_first(ranks: DataFrame, k: int = 40) -> DataFrame:
    """The upper bound that re-ordering the top k can reach: true ones first, else as they stood.
    It looks at the truth, so it is no prediction."""
    order = Window.partitionBy(*QUERY).orderBy(F.desc(F.col("rnk") > 0), "pos")
    return ranks.where(F.col("pos") <= k).withColumn("best_pos", F.row_number().over(order))


def hits_then_misses(cities: Column, truth: Column) -> Column:
    return F.concat(F.filter(cities, lambda c: F.array_contains(truth, c)), F.filter(cities, lambda c: ~F.array_contains(truth, c)))


def query_numbers(df: DataFrame) -> DataFrame:
    """A stable 64-bit number for each query, without a global sort."""
    return df.withColumn("qid", F.xxhash64(*QUERY))


def dense_query_numbers(df: DataFrame) -> DataFrame:
    """Numbers from 0 in (yr, type_id) order, over all years; the years and the beginnings of the ids
    (what comes before the city) are the buckets."""
    queries = numbered(df.select(*QUERY).distinct(), (), F.struct("yr", F.substring("type_id", 1, 20)), "type_id")
    return df.join(queries.select(*QUERY, (F.col("_k") - 1).alias("qid")), list(QUERY))


def running_precision(ranks: DataFrame) -> DataFrame:
    """Share of true ones up to each position."""
    so_far = Window.partitionBy(*QUERY).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return ranks.withColumn("precision_at", F.sum((F.col("rnk") > 0).cast("int")).over(so_far) / F.col("pos"))
