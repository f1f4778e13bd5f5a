"""Samples of queries and candidates that any engine repeats: order by md5 of a seed and the keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators.numbering import numbered

QUERY = ("yr", "type_id")


def turn(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def unit(order: Column) -> Column:
    """A number in [0, 1) of the first eight hexadecimal digits."""
    return F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / 4294967296.0


def with_positive(df: DataFrame) -> DataFrame:
    """Queries that have a positive, with all their rows."""
    return df.withColumn("_any", F.max("label").over(Window.partitionBy(*QUERY))).where("_any > 0").drop("_any")


def _ordered_queries(df: DataFrame, seed: int) -> DataFrame:
    """Each year's queries numbered (_k of _n) by hash; the first three of its digits are the buckets."""
    queries = df.select(*QUERY).distinct().withColumn("_turn", turn(seed, *QUERY))
    return numbered(queries, ("yr",), F.substring("_turn", 1, 3), "_turn", "type_id", total="_n")


def _of(df: DataFrame, queries: DataFrame) -> DataFrame:
    return df.join(queries.select(*QUERY), list(QUERY), "left_semi")


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42, least: int = 0) -> DataFrame:
    """That share of each year's queries (rounded down, `least` at least), with all their rows."""
    return _of(df, _ordered_queries(df, seed).where(F.col("_k") <= F.greatest(F.lit(least), F.floor(F.col("_n") * fraction))))


def sample_count(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return _of(df, _ordered_queries(df, seed).where(F.col("_k") <= n))


def split_train_validation(df: DataFrame, train: int, validation: int, seed: int = 42) -> DataFrame:
    """Adds `split`; the year's first `train` queries and the next `validation`, no others."""
    k = F.col("_k")
    split = F.when(k <= train, "train").when(k <= train + validation, "val")
    chosen = _ordered_queries(df, seed).withColumn("split", split).where("split is not null").select(*QUERY, "split")
    return df.join(chosen, list(QUERY))


def split_by_year(df: DataFrame, train: tuple[int, int], validation: tuple[int, int], test: tuple[int, int]) -> DataFrame:
    split = F.lit(None).cast("string")
    for name, (first, last) in (("test", test), ("val", validation), ("train", train)):
        split = F.when(F.col("yr").between(first, last), name).otherwise(split)
    return df.withColumn("split", split).where("split is not null")


def year_batches(df: DataFrame, start: int, size: int = 3) -> DataFrame:
    return df.withColumn("batch", F.floor((F.col("yr") - start) / size).cast("int"))


def sample_candidates(pairs: DataFrame, ratio: float, seed: int = 42, least: int = 20) -> DataFrame:
    """Of each origin's candidates that share, `least` at least."""
    origin = Window.partitionBy("yr", "from_city")
    k, n = F.row_number().over(origin.orderBy(turn(seed, "yr", "from_city", "to_city"), "to_city")), F.count("*").over(origin)
    return pairs.withColumn("_k", k).withColumn("_n", n).where(F.col("_k") <= F.greatest(F.lit(least), F.floor(F.col("_n") * ratio))).drop("_k", "_n")


def sample_common(left: DataFrame, right: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n of the queries that both hold."""
    both = left.select(*QUERY).distinct().intersect(right.select(*QUERY).distinct())
    return both.orderBy(turn(seed, *QUERY), *QUERY).limit(n)


def _least(negatives: DataFrame, most: int, seed: int, *group: str) -> DataFrame:
    """The `most` rows of each query (and group) that come first by hash, as _k. The literal bound lets each
    task give up all but that many of a group before anything is moved."""
    k = F.row_number().over(Window.partitionBy(*QUERY, *group).orderBy(turn(seed, *QUERY, "to_city"), "to_city"))
    return negatives.withColumn("_k", k).where(F.col("_k") <= most)


def stratified_negatives(df: DataFrame, hard: list[int], n_hard: int = 30, n_other: int = 30, seed: int = 42) -> DataFrame:
    """All positives, and some negatives to hard cities and to others; df is read twice, and of its
    negatives only those that may stay are moved."""
    stratum = F.when(F.col("rnk") > 0, 0).when(F.col("to_city").isin(hard), 1).otherwise(2)
    df = df.withColumn("stratum", stratum)
    least = _least(df.where("stratum > 0"), max(n_hard, n_other), seed, "stratum")
    least = least.where(F.col("_k") <= F.when(F.col("stratum") == 1, n_hard).otherwise(n_other)).drop("_k")
    return df.where("stratum = 0").unionByName(least)


def is_hard(hard: list[int]) -> Column:
    """A fixed list of cities, or the origin's province."""
    return F.col("to_city").isin(hard) | (F.floor(F.col("from_city") / 100) == F.floor(F.col("to_city") / 100))


def keep_share(df: DataFrame, hard: list[int], n: int, seed: int = 42) -> DataFrame:
    """Positives and hard negatives stay; others stay with chance n / their number in the query."""
    sure = (F.col("rnk") > 0) | is_hard(hard)
    rest = F.sum(F.when(~sure, 1).otherwise(0)).over(Window.partitionBy(*QUERY))
    chance = F.least(F.lit(1.0), F.lit(float(n)) / F.greatest(rest, F.lit(1)))
    return df.withColumn("_p", chance).where(sure | (unit(turn(seed, *QUERY, "to_city")) < F.col("_p"))).drop("_p")


def exact_negatives(df: DataFrame, n: int | None, seed: int = 42) -> DataFrame:
    """n negatives of each query (all if n is None or negative) beside its positives."""
    if n is None or n < 0:
        return df
    positive = F.coalesce(F.col("rnk") > 0, F.lit(False))
    return df.where(positive).unionByName(_least(df.where(~positive), n, seed).drop("_k"))


def drop_history(df: DataFrame, columns: list[str], p: float, seed: int = 42) -> DataFrame:
    """In training, history is blanked for a share p of the rows."""
    keep = unit(turn(seed, *QUERY, "to_city")) >= p
    return df.withColumns({c: F.when(keep, F.col(c)).otherwise(0) for c in columns})
