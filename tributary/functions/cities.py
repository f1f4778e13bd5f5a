"""City ids, names and provinces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_int(value: Column) -> Column:
    """-1 where there is no integer."""
    return F.coalesce(value.try_cast("int"), F.lit(-1))


def city_id(text: Column) -> Column:
    """The number in parentheses, else the whole string as one; null if neither."""
    return F.coalesce(F.regexp_extract(text, r"\((\d+)\)", 1).try_cast("int"), text.try_cast("int"))


def city_id_robust(text: Column) -> Column:
    """All digits, else the number in parentheses, else the last run of digits, else 0."""
    plain = F.trim(text)
    last = F.try_element_at(F.regexp_extract_all(plain, F.lit(r"(\d+)"), F.lit(1)), F.lit(-1))
    whole = F.when(plain.rlike(r"^\d+$"), plain.try_cast("int"))
    return F.coalesce(whole, F.regexp_extract(plain, r"\((\d+)\)", 1).try_cast("int"), last.try_cast("int"), F.lit(0))


def province(city: Column) -> Column:
    return F.floor(city / 100).cast("int")


def province_key(city: Column) -> Column:
    """How the maps of migrants' origins write a province."""
    return (province(city) * 100).cast("string")


def with_names(df: DataFrame, nodes: DataFrame, column: str = "to_city", into: str = "city_name") -> DataFrame:
    """City names by id, `Unknown` where there is none; of several names of an id the least."""
    known = nodes.groupBy(F.col("city_id").alias("_id")).agg(F.min("city_name").alias("_name"))
    return df.join(known, F.col(column) == F.col("_id"), "left").withColumn(into, F.coalesce("_name", F.lit("Unknown"))).drop("_id", "_name")


def ids_of(df: DataFrame, nodes: DataFrame, column: str = "city_name", into: str = "city_id") -> DataFrame:
    """City ids by name, null where there is none."""
    known = nodes.groupBy(F.col("city_name").alias("_name")).agg(F.min("city_id").alias("_id"))
    return df.join(known, F.col(column) == F.col("_name"), "left").withColumn(into, F.col("_id")).drop("_id", "_name")
