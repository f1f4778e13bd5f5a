"""Codes of categories, fitted on some rows and given to others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The code of a value that was not there when the codes were fitted, and of a missing one.
UNSEEN = -1


def fit_codes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, code): the values of each column in order, numbered from 0. A row a value."""
    values = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("v")).select("v.*")
    code = F.row_number().over(Window.partitionBy("column_name").orderBy("value")) - 1
    return values.where("value is not null").distinct().withColumn("code", code)


def with_codes(rows: DataFrame, codes: DataFrame, columns: list[str]) -> DataFrame:
    """Adds <column>_code for each column; one join a column with the values it has, which Spark sends along
    while they are few."""

    def coded(df: DataFrame, c: str) -> DataFrame:
        own = codes.where(F.col("column_name") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        joined = df.join(own, F.col(c).cast("string") == F.col("_value"), "left")
        return joined.withColumn(f"{c}_code", F.coalesce("_code", F.lit(UNSEEN))).drop("_value", "_code")

    return reduce(coded, columns, rows)


def save_codes(codes: DataFrame, folder: str) -> str:
    """Beside a model: scoring reads the codes that training used."""
    codes.coalesce(1).write.mode("overwrite").parquet(f"{folder}/categories")
    return folder


def load_codes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("column_name string, value string, code int").parquet(f"{folder}/categories")
