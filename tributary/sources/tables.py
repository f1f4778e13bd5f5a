"""Readers and writers of facts, cities, edges, candidate lists and feature tables.

Tables are Parquet partitioned by `yr`, so a year's filter prunes partitions; nested yearly city
attributes, edges, nodes, type lists and candidate lists are JSON lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOP = 20
SECTORS = ("agriculture", "manufacturing", "traditional_services", "modern_services")
_SECTOR = "struct<share:double,avg_wage:double,vacancy_rate:double>"
#: One line of a year's cities.
CITY_SCHEMA = (
    "city_id string, city_name string, basic_info struct<tier:int,coordinates:array<double>,area_sqkm:double>, "
    f"economy struct<gdp_per_capita:double,cpi_index:double,unemployment_rate:double,industry_sectors:struct<{','.join(f'{s}:{_SECTOR}' for s in SECTORS)}>>, "
    "demographics struct<age_structure:map<string,double>,sex_ratio:double>, living_cost struct<housing_price_avg:double,rent_avg:double,daily_cost_index:double>, "
    "public_services struct<medical_score:double,education_score:double,transport_convenience:double,avg_commute_mins:double>, "
    "social_context struct<population_total:double,migrant_stock_distribution:map<string,double>>"
)
AGES = ("0_17", "18_34", "35_54", "55_64", "65_plus")


def scan_facts(facts: DataFrame, year: int) -> DataFrame:
    return facts.where(F.col("yr") == year).select("type_id", *[f"To_Top{k}" for k in range(1, TOP + 1)])


def rows_per_year(df: DataFrame) -> DataFrame:
    return df.groupBy("yr").agg(F.count("*").alias("n_rows"))


def latest_month(facts: DataFrame) -> DataFrame:
    """One row for each (yr, type_id): the last month's."""
    last = facts.groupBy("yr", "type_id").agg(F.max("month").alias("month"))
    return facts.join(last, ["yr", "type_id", "month"], "left_semi")


def wide_to_long(facts: DataFrame, to: Column) -> DataFrame:
    """To_Top1..20 and their counts as rows (rank from 1, to_city by `to` of column `to_text`, n)."""
    slots = F.array(*[F.struct(F.col(f"To_Top{k}").alias("to_text"), F.col(f"To_Top{k}_Count").alias("n")) for k in range(1, TOP + 1)])
    long = facts.select("yr", "type_id", F.posexplode(slots).alias("slot", "d")).select("yr", "type_id", (F.col("slot") + 1).alias("rnk"), "d.to_text", "d.n")
    return long.where("to_text is not null").withColumn("to_city", to)


def long_to_wide(long: DataFrame) -> DataFrame:
    return long.groupBy("yr", "type_id").agg(*[F.max(F.when(F.col("rnk") == k, F.col("to_city"))).alias(f"to_{k}") for k in range(1, TOP + 1)])


def scan_columns(df: DataFrame, year: int, *columns: str) -> DataFrame:
    return df.where(F.col("yr") == year).select(*columns)


def city_attributes(lines: DataFrame, ages: tuple[str, ...] = AGES) -> DataFrame:
    """Nested city lines (yr, value: JSON) as flat columns: missing sectors and ages 0, sex ratio 100."""
    c = lines.select("yr", F.from_json("value", CITY_SCHEMA).alias("c"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    flat = {"city_id": F.col("c.city_id").try_cast("int"), "tier": F.col("c.basic_info.tier"), "area_sqkm": zero("c.basic_info.area_sqkm")}
    flat |= {k: zero(f"c.economy.{k}") for k in ("gdp_per_capita", "cpi_index", "unemployment_rate")}
    flat |= {f"{s}_{k}": zero(f"c.economy.industry_sectors.{s}.{k}") for s in SECTORS for k in ("share", "avg_wage", "vacancy_rate")}
    flat |= {f"age_{a}": F.coalesce(F.try_element_at("c.demographics.age_structure", F.lit(a)), F.lit(0.0)) for a in ages}
    flat |= {"sex_ratio": F.coalesce("c.demographics.sex_ratio", F.lit(100.0))}
    flat |= {k: zero(f"c.living_cost.{k}") for k in ("housing_price_avg", "rent_avg", "daily_cost_index")}
    flat |= {k: zero(f"c.public_services.{k}") for k in ("medical_score", "education_score", "transport_convenience", "avg_commute_mins")}
    flat |= {"population_total": zero("c.social_context.population_total"), "stock": F.col("c.social_context.migrant_stock_distribution")}
    return c.select("yr", *[v.alias(k) for k, v in flat.items()])


def city_attributes_earlier(lines: DataFrame) -> DataFrame:
    """The earlier flavour: 21 columns, sectors without vacancies, no ages, no sex ratio."""
    c = lines.select("yr", F.from_json("value", CITY_SCHEMA).alias("c"))
    flat = {"city_id": F.col("c.city_id").try_cast("int"), "city_name": F.col("c.city_name"), "tier": F.col("c.basic_info.tier"), "area_sqkm": F.col("c.basic_info.area_sqkm")}
    flat |= {k: F.col(f"c.economy.{k}") for k in ("gdp_per_capita", "cpi_index", "unemployment_rate")}
    flat |= {f"{s}_{k}": F.coalesce(f"c.economy.industry_sectors.{s}.{v}", F.lit(0.0)) for s in SECTORS for k, v in (("share", "share"), ("wage", "avg_wage"))}
    flat |= {k: F.col(f"c.living_cost.{k}") for k in ("housing_price_avg", "rent_avg", "daily_cost_index")}
    flat |= {k: F.col(f"c.public_services.{k}") for k in ("medical_score", "education_score", "transport_convenience", "avg_commute_mins")}
    flat |= {"population_total": F.col("c.social_context.population_total")}
    return c.select("yr", *[v.alias(k) for k, v in flat.items()])


def edges(df: DataFrame) -> DataFrame:
    """source_id and target_id as numbers, weights as doubles, repeated edges once."""
    return df.select(F.col("source_id").try_cast("int").alias("source_id"), F.col("target_id").try_cast("int").alias("target_id"), F.col("w_geo").cast("double").alias("w_geo"), F.col("w_dialect").cast("double").alias("w_dialect")).distinct()


def nodes(lines: DataFrame) -> DataFrame:
    """JSON lines {city_id, name}; blank lines are skipped."""
    c = lines.where(F.trim("value") != "").select(F.from_json("value", "city_id string, name string").alias("c"))
    return c.select(F.col("c.city_id").try_cast("int").alias("city_id"), F.col("c.name").alias("city_name"))


def listed_cities(types: DataFrame) -> DataFrame:
    """Cities of a list of type ids (place, id), once each, with where they first stand."""
    city = F.element_at(F.split("id", "_"), -1).try_cast("int")
    return types.groupBy(city.alias("city_id")).agg(F.min("place").alias("first_place"))


def candidate_lists(lines: DataFrame, k: int | None = 100) -> DataFrame:
    """Lines whose key is the type id, its value a list or {top_cities: list}; at most k cities."""
    plain = F.from_json("value", "map<string,array<int>>")  # null for the other shape
    held = F.transform_values(F.from_json("value", "map<string,struct<top_cities:array<int>>>"), lambda _, v: v["top_cities"])
    out = lines.select("yr", F.explode(F.coalesce(plain, held)).alias("type_id", "cities"))
    return out.withColumn("cities", F.slice("cities", 1, k)) if k else out


def json_lines(lists: DataFrame, k: int = 100) -> DataFrame:
    """One line a query: {type_id: first k cities}."""
    return lists.select("yr", F.to_json(F.create_map("type_id", F.slice("cities", 1, k))).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files in a folder a year; files appear when the job commits, whole or not at all."""
    lines.write.mode("overwrite").partitionBy("yr").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(yr, value) of JSON lines in folders yr=..., all years at once."""
    return spark.read.text(path).select(F.col("yr").cast("int").alias("yr"), "value")


def write_years(df: DataFrame, path: str, reset: bool = False) -> None:
    """One folder a year; a rerun replaces the years it holds and no others, or all with `reset`."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static" if reset else "dynamic").partitionBy("yr").parquet(path)


def write_split(df: DataFrame, path: str) -> None:
    """Training rows in folders by split (train, val) and year; what a model is validated on is read
    back by its folder."""
    df.write.mode("overwrite").partitionBy("split", "yr").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split).withColumn("yr", F.col("yr").cast("int"))


def repeated_keys(lists: DataFrame) -> DataFrame:
    """Total and distinct keys of an export, per year."""
    keys = lists.groupBy("yr", "type_id").agg(F.count("*").alias("n"))
    return keys.groupBy("yr").agg(F.sum("n").alias("total"), F.count("*").alias("unique_keys"), F.sum((F.col("n") > 1).cast("int")).alias("repeated"))


def years_left(requested: DataFrame, done: DataFrame) -> DataFrame:
    """Requested years that are not written yet."""
    return requested.select("yr").distinct().join(done.select("yr").distinct(), "yr", "left_anti")


def years_present(df: DataFrame, years: list[int], on_missing: str = "skip") -> DataFrame:
    """Rows of the given years; a year without rows is skipped or, with "raise", an error."""
    out = df.where(F.col("yr").isin(years))
    if on_missing == "raise":
        there = {r["yr"] for r in out.select("yr").distinct().collect()}  # a row a year asked for
        if missing := sorted(set(years) - there):
            raise FileNotFoundError(f"no rows of {missing}")
    return out
