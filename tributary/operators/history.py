"""What earlier years say about a flow (type_id, from_city, to_city)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_year_score(base: DataFrame, flows: DataFrame) -> DataFrame:
    """The flow of the year before as a score, 0 if there was none."""
    before = flows.select((F.col("yr") + 1).alias("yr"), "type_id", "to_city", F.col("n").alias("_n"))
    return base.join(before, ["yr", "type_id", "to_city"], "left").withColumn("score", F.coalesce(F.col("_n").cast("double"), F.lit(0.0))).drop("_n")


def with_history(flows: DataFrame, spans: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """flows (yr, type_id, from_city, to_city, n, rnk, label) with, for each span of years before:
    the number of years seen, their least rank and mean label; and last year's log flow and share."""
    year = F.sum("n").over(Window.partitionBy("yr", "type_id", "from_city"))
    own = Window.partitionBy("type_id", "from_city", "to_city").orderBy("yr")
    at = flows.withColumn("share", F.col("n") / year)
    last = own.rangeBetween(-1, -1)
    out = {"hist_log_flow": F.log1p(F.coalesce(F.max("n").over(last), F.lit(0))), "hist_share": F.coalesce(F.max("share").over(last), F.lit(0.0)), "hist_rank": F.coalesce(F.max("rnk").over(last), F.lit(999)), "hist_label": F.coalesce(F.max("label").over(last), F.lit(0))}
    for k in spans:
        span = own.rangeBetween(-k, -1)
        out |= {f"hist_years_{k}": F.count("*").over(span), f"hist_best_{k}": F.coalesce(F.min("rnk").over(span), F.lit(999)), f"hist_mean_{k}": F.coalesce(F.avg("label").over(span), F.lit(0.0))}
    return at.withColumns(out).drop("share")


def with_past(base: DataFrame, flows: DataFrame, years: int = 3) -> DataFrame:
    """What the years before a row's own had on its destination: last year's log flow and its share of the
    query's, and the share of the last `years` together, 0 where there was none. One join."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy("yr", "type_id"))
    past = flows.withColumn("share", share).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(years))))
    last = lambda c: F.sum(F.when(F.col("k") == 1, F.col(c)))
    past = past.groupBy((F.col("yr") + F.col("k")).alias("yr"), "type_id", "to_city").agg(last("n").alias("_n"), last("share").alias("_share"), F.sum("n").alias("_all"))
    past = past.withColumn("_all", F.col("_all") / F.sum("_all").over(Window.partitionBy("yr", "type_id")))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return base.join(past, ["yr", "type_id", "to_city"], "left").withColumns({"hist_log_flow": F.log1p(zero("_n")), "hist_share": zero("_share"), "hist_share_3": zero("_all")}).drop("_n", "_share", "_all")
