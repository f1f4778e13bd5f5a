"""Numeric features of a pair of cities and of a person's view of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MOST, LARGEST_DIFF, TINY = 0.01, 100.0, 1e8, 1e-9


def finite(value: Column) -> Column:
    """0 for null, NaN and the infinities."""
    v = value.cast("double")
    return F.when(v.isNull() | F.isnan(v) | F.abs(v).isin(float("inf")), 0.0).otherwise(v)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def ratio(to: Column, frm: Column, low: float = LEAST, high: float = MOST) -> Column:
    """to / from, both finite, within bounds; a divisor next to 0 counts as TINY."""
    return clip(to / F.when(F.abs(frm) < TINY, TINY).otherwise(frm), low, high)


def safe_ratio(to: Column, frm: Column, low: float = LEAST, high: float = MOST) -> Column:
    """ratio() of any numbers."""
    return ratio(finite(to), finite(frm), low, high)


def smoothed_ratio(to: Column, frm: Column, low: float = 0.1, high: float = 10.0) -> Column:
    """The earlier form: 1 where the divisor is next to 0."""
    return clip(F.when(finite(frm) > 1e-5, finite(to) / (finite(frm) + 1e-5)).otherwise(1.0), low, high)


def diff(to: Column, frm: Column) -> Column:
    return clip(to - frm, -LARGEST_DIFF, LARGEST_DIFF)


def safe_diff(to: Column, frm: Column) -> Column:
    return diff(finite(to), finite(frm))


def by_industry(columns: list[str], industry: str = "industry") -> Column:
    """The column of the person's industry, its number kept within the list."""
    place = F.least(F.greatest(F.col(industry), F.lit(0)), F.lit(len(columns) - 1)) + 1
    return F.element_at(F.array(*map(F.col, columns)), place.cast("int"))


def cross_features(df: DataFrame, wages: list[str], vacancies: list[str]) -> DataFrame:
    """Six features that join the person's dimensions with the pair's."""
    return df.withColumns({
        "industry_wage_ratio": by_industry(wages),
        "industry_vacancy_ratio": by_industry(vacancies),
        "education_tier": F.col("education") * F.col("tier_diff"),
        "income_gdp": F.col("income") * F.col("gdp_per_capita_ratio"),
        "age_housing": F.col("age_group") * F.col("housing_price_avg_ratio"),
        "family_population": F.col("family") * F.col("population_total_ratio"),
    })


def downcast(df: DataFrame) -> DataFrame:
    """Integers to the least width that holds what is there, doubles to float; one pass for bounds."""
    ints = [c for c, t in df.dtypes if t in ("bigint", "int", "smallint")]
    bounds = df.agg(*[f(c).alias(f"{n}_{c}") for c in ints for n, f in (("lo", F.min), ("hi", F.max))]).first() if ints else {}
    out = df
    for c in ints:
        lo, hi = bounds[f"lo_{c}"] or 0, bounds[f"hi_{c}"] or 0
        kind = next((k for k, n in (("tinyint", 7), ("smallint", 15), ("int", 31)) if -(1 << n) <= lo and hi < 1 << n), "bigint")
        out = out.withColumn(c, F.col(c).cast(kind))
    return reduce(lambda d, c: d.withColumn(c, F.col(c).cast("float")), [c for c, t in df.dtypes if t == "double"], out)


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    return reduce(lambda d, c: d.withColumn(c, finite(F.col(c))), columns, df)


def feature_columns(df: DataFrame, drop: tuple[str, ...] = ("yr", "type_id", "type_id_orig", "from_city", "to_city", "rnk", "label", "weight", "n", "parse_ok")) -> list[str]:
    """Every column but ids, labels and helpers, in the frame's order."""
    return [c for c in df.columns if c not in drop]


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, low, high) of numbers: values that are there, least and greatest; one pass."""
    own = [F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n"), F.min(F.col(c).cast("double")).alias("low"), F.max(F.col(c).cast("double")).alias("high")) for c in columns]
    return df.agg(F.array(*own).alias("own")).select(F.inline("own"))


def lacking(df: DataFrame, *columns: str) -> DataFrame:
    """(column_name, there, lacking) of required columns: whether the frame has it, rows without a value."""
    own = [F.struct(F.lit(c).alias("column_name"), F.lit(int(c in df.columns)).alias("there"), (F.count("*") - (F.count(c) if c in df.columns else F.lit(0))).alias("lacking")) for c in columns]
    return df.agg(F.array(*own).alias("own")).select(F.inline("own"))


def missing(df: DataFrame, *columns: str) -> list[str]:
    return [c for c in columns if c not in df.columns]


def require(df: DataFrame, *columns: str) -> DataFrame:
    if lacking := missing(df, *columns):
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    return df


def with_placeholders(df: DataFrame) -> DataFrame:
    """Where there is no truth to score against: flow 0, rank 999, label 0."""
    return df.withColumns({c: F.lit(v) for c, v in (("n", 0), ("rnk", 999), ("label", 0)) if c not in df.columns})
