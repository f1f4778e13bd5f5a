"""Candidate destinations of a query (yr, type_id, from_city)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("yr", "type_id", "to_city")


def expand(queries: DataFrame, cities: DataFrame, include_self: bool = False) -> DataFrame:
    """Each query with every city: that product is what is asked for. No hint is given, so the list of
    cities is broadcast only while its size is under Spark's own bound."""
    both = queries.crossJoin(cities.select(F.col("city_id").alias("to_city")))
    return both if include_self else both.where("to_city <> from_city")


def drop_self(df: DataFrame) -> DataFrame:
    return df.where("to_city <> from_city")


def known_cities(pairs: DataFrame) -> DataFrame:
    """Ids that stand at either end of a pair."""
    return pairs.select(F.col("from_city").alias("city_id")).union(pairs.select(F.col("to_city"))).distinct()


def keep_known(df: DataFrame, pairs: DataFrame) -> DataFrame:
    return df.join(known_cities(pairs).withColumnRenamed("city_id", "to_city"), "to_city", "left_semi")


def keep_reachable(df: DataFrame, roads: DataFrame) -> DataFrame:
    """Candidates to which a road leads from the origin, whatever the year."""
    return df.join(roads, ["from_city", "to_city"], "left_semi")


def origins(df: DataFrame) -> DataFrame:
    """The year's pool of candidates: the cities that queries start from."""
    return df.select("yr", F.col("from_city").alias("city_id")).distinct()


def lists_by_origin(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("yr", "from_city").agg(F.sort_array(F.collect_set("to_city")).alias("cities"))


def from_lists(queries: DataFrame, lists: DataFrame) -> DataFrame:
    """A query's listed candidates with their place; queries without a list are dropped."""
    return queries.join(lists, ["yr", "type_id"]).select(*queries.columns, F.posexplode("cities").alias("place", "to_city")).withColumn("place", F.col("place") + 1)


def hard_pool(recalled: DataFrame, truth: DataFrame) -> DataFrame:
    """Recalled and true destinations together, once each, without the origin."""
    columns = ["yr", "type_id", "from_city", "to_city"]
    return drop_self(recalled.select(*columns).union(truth.select(*columns)).distinct())


def with_truth(df: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds rnk, 0 for what is not in the truth."""
    return df.join(truth.select(*KEY, F.col("rnk").alias("_rnk")), list(KEY), "left").withColumn("rnk", F.coalesce("_rnk", F.lit(0))).drop("_rnk")


def in_query_order(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Every request by its number with its results, an empty list where there are none."""
    joined = requests.join(results, ["yr", "type_id"], "left")
    return joined.withColumn("cities", F.coalesce("cities", F.array().cast("array<int>")))
