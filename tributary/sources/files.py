"""JSON lines in files or folders named by year: what is there, what is missing, what is broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _year(path: Column, name: str) -> Column:
    """The year in a path, where `name` has {yr}."""
    before, after = name.split("{yr}")
    return F.regexp_extract(path, f"/{before}(\\d{{4}}){after}(?:/|$)", 1).try_cast("int")


def years_there(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(yr, files, bytes) by listing; no file is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    found = listed.select(_year(F.col("path"), name).alias("yr"), "length").where("yr is not null and length > 0")
    return found.groupBy("yr").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def years_missing(requested: DataFrame, there: DataFrame) -> DataFrame:
    return requested.select("yr").distinct().join(there.select("yr"), "yr", "left_anti")


def read_lines(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """(yr, place, c, broken) of every line but blank ones: the year of the file, the line as `schema`, or, if it
    is not JSON, the line itself in `broken`; a broken line loses no other. place: the file it stands in."""
    lines = spark.read.option("recursiveFileLookup", True).text(folder).select("value", F.col("_metadata.file_path").alias("path"))
    lines = lines.select(_year(F.col("path"), name).alias("yr"), F.regexp_extract("path", "([^/]+)$", 1).alias("place"), "value")
    lines = lines.where("yr is not null and trim(value) <> ''")
    read = F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"})
    out = lines.select("yr", "place", read.alias("c"))
    return out.select("yr", "place", F.when(F.col("c._broken").isNull(), F.col("c")).alias("c"), F.col("c._broken").alias("broken"))
