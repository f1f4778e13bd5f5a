"""Person types: six ordinal dimensions and an origin city, written as one string."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The codes of each dimension, in order; a code's place is its number.
GENDER = ("M", "F")
AGE = ("20", "30", "40", "55", "65")
AGE_EARLIER = ("16", "20", "35", "50", "60")
EDUCATION = ("EduLo", "EduMid", "EduHi")
INDUSTRY = ("Agri", "Mfg", "Service", "Wht")
INCOME = ("IncL", "IncML", "IncM", "IncMH", "IncH")
FAMILY = ("Split", "Unit")

DIMENSIONS = {"gender": GENDER, "age_group": AGE, "education": EDUCATION, "industry": INDUSTRY, "income": INCOME, "family": FAMILY}


def dimensions(age: tuple[str, ...] = AGE) -> dict[str, tuple[str, ...]]:
    return DIMENSIONS | {"age_group": age}


def code(part: Column, codes: tuple[str, ...]) -> Column:
    """A code's number, null if it is not one."""
    known = F.create_map(*[x for k, c in enumerate(codes) for x in (F.lit(c), F.lit(k))])
    return F.try_element_at(known, part)


def parse(df: DataFrame, column: str = "type_id", origin: str | None = None, age: tuple[str, ...] = AGE) -> DataFrame:
    """Adds the six codes, from_city and parse_ok.

    Seven parts end in the origin; six take it from column `origin`, if given. Anything else, an
    unknown code or an origin that is not a number makes parse_ok false.
    """
    parts = F.split(column, "_")
    for k, (name, codes) in enumerate(dimensions(age).items()):
        df = df.withColumn(name, code(F.get(parts, F.lit(k)), codes))
    own = F.when(F.size(parts) == 7, F.get(parts, F.lit(6)).try_cast("int"))
    if origin:
        own = own.when(F.size(parts) == 6, F.col(origin).try_cast("int"))
    df = df.withColumn("parsed_city", own)
    whole = F.lit(True)
    for name in DIMENSIONS:
        whole = whole & F.col(name).isNotNull()
    ok = F.coalesce(whole & F.col("parsed_city").isNotNull(), F.lit(False))
    return df.withColumn("parse_ok", ok).withColumn("from_city", F.col("parsed_city")).drop("parsed_city")


def parse_strict(df: DataFrame, column: str = "type_id", age: tuple[str, ...] = AGE) -> DataFrame:
    """As parse(), but a bad type id fails the job."""
    parsed = parse(df, column, age=age)
    return parsed.withColumn("gender", F.when(F.col("parse_ok"), F.col("gender")).otherwise(F.raise_error(F.concat(F.lit("bad type id: "), column)))).drop("parse_ok")


def parse_lenient(df: DataFrame, column: str = "type_id", age: tuple[str, ...] = AGE) -> DataFrame:
    """Unknown codes count as 0; keeps the id as type_id_orig and drops it."""
    parts = F.split(column, "_")
    for k, (name, codes) in enumerate(dimensions(age).items()):
        df = df.withColumn(name, F.coalesce(code(F.get(parts, F.lit(k)), codes), F.lit(0)))
    return df.withColumn("type_id_orig", F.col(column)).drop(column)


def encoded(age: tuple[str, ...] = AGE, origin: str = "from_city") -> Column:
    """The type id of the six codes and the origin."""
    parts = [F.get(F.array(*map(F.lit, codes)), F.col(name)) for name, codes in dimensions(age).items()]
    return F.concat_ws("_", *parts, F.col(origin).cast("string"))


def every_person(df: DataFrame, origin: str = "from_city", age: tuple[str, ...] = AGE) -> DataFrame:
    """Each origin with all 1,200 person types."""
    for name, codes in dimensions(age).items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(k) for k in range(len(codes))])))
    return df.withColumn("type_id", encoded(age, origin))


def person_count(age: tuple[str, ...] = AGE) -> int:
    return sum(1 for _ in product(*dimensions(age).values()))
