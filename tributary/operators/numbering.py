"""Exact row numbers without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, group: tuple[str, ...], bucket: Column, *order: str | Column, into: str = "_k", total: str | None = None) -> DataFrame:
    """Adds `into`, 1, 2, ... within `group` in the order of (bucket, *order), and `total`, the group's rows.

    `bucket` must rise with the wanted order. Rows are numbered within their bucket; only the
    buckets' sizes, a row each, are added up within a group. A bucket is one task's sort, so there
    should be many: the first digits of a hash, the beginning of a text.
    """
    rows = df.withColumn("_bucket", bucket)
    keys = [*group, "_bucket"]
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_total", F.sum("_size").over(whole)).drop("_size")
    rows = rows.withColumn("_within", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = rows.join(sizes, keys).withColumn(into, F.col("_before") + F.col("_within"))
    return (out.withColumn(total, F.col("_total")) if total else out).drop("_bucket", "_before", "_total", "_within")
