"""What has been written whole, kept as a small table beside it.

A line is appended after the data it speaks of, so data without a line was not finished and is written
again. Lines are never changed; a folder without a ledger has none.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "what string, n_rows long, digest long, at timestamp"


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a folder's ledger: what, n_rows, digest, at."""
    try:
        return spark.read.schema(LINES).parquet(f"{folder}/ledger")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LINES)


def record(spark: SparkSession, folder: str, what: str, n_rows: int, digest: int = 0) -> None:
    line = spark.range(1).select(F.lit(what).alias("what"), F.lit(n_rows).cast("long").alias("n_rows"), F.lit(digest).cast("long").alias("digest"), F.current_timestamp().alias("at"))
    line.write.mode("append").parquet(f"{folder}/ledger")


def key_digest(*keys: str) -> Column:
    """A number of a set of rows that doesn't depend on their order: eight digits of each key's md5, added up."""
    digits = F.substring(F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).cast("binary")), 1, 8)
    return F.coalesce(F.sum(F.conv(digits, 16, 10).cast("long")), F.lit(0))


def years_to_write(requested: DataFrame, folder: str) -> DataFrame:
    """Requested years (yr) that the ledger of the folder doesn't have."""
    done = committed(requested.sparkSession, folder).select(F.col("what").try_cast("int").alias("yr"))
    return requested.select("yr").distinct().join(done, "yr", "left_anti")


def write_missing_years(df: DataFrame, folder: str, *keys: str, most: int | None = None) -> list[int]:
    """Write the years of df that the folder's ledger doesn't have, each as one job into `yr=...`, and commit
    each with its rows and the digest of its keys; `most` years at a time. Gives the years written.

    A year that an earlier run began and didn't commit is written over; committed years are not touched. A
    year whose files don't hold what was to be written is an error, and not committed.
    """
    spark = df.sparkSession
    years = sorted(r["yr"] for r in years_to_write(df, folder).collect())[:most]  # a row a year
    for yr in years:
        own, path = df.where(F.col("yr") == yr), f"{folder}/data/yr={yr}"
        own.drop("yr").write.mode("overwrite").parquet(path)
        about = [F.count("*").alias("n"), key_digest(*keys).alias("digest")]
        there, meant = spark.read.parquet(path).agg(*about).first(), own.agg(*about).first()
        if there != meant:
            raise OSError(f"{path} holds {there['n']} rows of {meant['n']}")
        record(spark, folder, str(yr), there["n"], there["digest"])
    return years


def read_years(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the committed years only."""
    data = spark.read.parquet(f"{folder}/data").withColumn("yr", F.col("yr").cast("int"))
    return data.join(committed(spark, folder).select(F.col("what").try_cast("int").alias("yr")).distinct(), "yr", "left_semi")
