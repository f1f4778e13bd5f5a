"""City-pair features: each year's cities crossed, ratios and differences, edges and migrants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.cities import province, province_key
from tributary.functions.features import diff, finite, ratio, smoothed_ratio

#: Parts of a year's origins.
SALTS = 16


#: The longest method, in bytes, that the JVM compiles; generated code beyond it would be interpreted.
COMPILED = 8000


def compiled_in_parts(df: DataFrame) -> DataFrame:
    """Rows as wide as a pair's make one long method of a whole stage, which the JVM never compiles: with this
    setting Spark generates such a stage operator by operator instead. A limit that was set is left alone."""
    conf, key = df.sparkSession.conf, "spark.sql.codegen.hugeMethodLimit"
    if conf.get(key) == "65535":
        conf.set(key, str(COMPILED))
    return df


def _ends(cities: DataFrame) -> tuple[DataFrame, DataFrame]:
    side = lambda p: cities.select("yr", *[F.col(c).alias(f"{p}_{c}") for c in cities.columns if c != "yr"])
    return side("from").withColumnRenamed("from_city_id", "from_city"), side("to").withColumnRenamed("to_city_id", "to_city")


def city_pairs(cities: DataFrame) -> DataFrame:
    """All ordered pairs of different cities of a year, with both ends' attributes (from_, to_).

    The year is an equi key, so this is a hash join however many years there are. A year's origins
    are dealt over SALTS parts, each of which meets all destinations, so a year is no one task.
    """
    a, b = _ends(cities)
    a = a.withColumn("_salt", F.pmod(F.xxhash64("from_city"), F.lit(SALTS)).cast("int"))
    b = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return a.join(b, ["yr", "_salt"]).where("from_city <> to_city").drop("_salt")


def with_ends(pairs: DataFrame, cities: DataFrame) -> DataFrame:
    """Both ends' attributes of given pairs, null where a city is unknown."""
    a, b = _ends(cities)
    return pairs.join(a, ["yr", "from_city"], "left").join(b, ["yr", "to_city"], "left")


def with_edges(pairs: DataFrame, edges: DataFrame, missing: float = 0.0) -> DataFrame:
    known = edges.select(F.col("source_id").alias("from_city"), F.col("target_id").alias("to_city"), "w_geo", "w_dialect")
    joined = pairs.join(known, ["from_city", "to_city"], "left")
    return joined.withColumns({"geo_distance": F.coalesce("w_geo", F.lit(missing)), "dialect_distance": F.coalesce("w_dialect", F.lit(missing)), "edge_hit": F.col("w_geo").isNotNull()}).drop("w_geo", "w_dialect")


def with_migrants(pairs: DataFrame, migrants: DataFrame) -> DataFrame:
    """Share of the destination's migrants that come from the origin's province, 0 if unknown;
    migrants: (yr, to_city, stock: map of province to share)."""
    joined = pairs.join(migrants.select("yr", "to_city", "stock"), ["yr", "to_city"], "left")
    return joined.withColumn("migrant_stock_from_to", F.coalesce(F.try_element_at("stock", province_key(F.col("from_city"))), F.lit(0.0))).drop("stock")


def pair_features(cities: DataFrame, edges: DataFrame, migrants: DataFrame, ratios: list[str], diffs: list[str]) -> DataFrame:
    """The feature table of all years in one plan: ratios, differences, levels and network columns.

    What concerns one city (numbers made finite, logarithms) is done before cities are paired, a row a
    city, and a pair's features are one projection after the joins (compiled_in_parts()).
    """
    numbers = list(dict.fromkeys([*ratios, *diffs, "population_total", "gdp_per_capita"]))
    own = cities.select("yr", "city_id", "tier", *[finite(F.col(c)).alias(c) for c in numbers])
    own = own.withColumn("population_log", finite(F.log1p("population_total")))
    pairs = with_migrants(with_edges(city_pairs(own), edges), migrants)
    out = [ratio(F.col(f"to_{c}"), F.col(f"from_{c}")).alias(f"{c}_ratio") for c in ratios]
    out += [diff(F.col(f"to_{c}"), F.col(f"from_{c}")).alias(f"{c}_diff") for c in diffs]
    out += ["to_tier", "to_population_log", "to_gdp_per_capita", "from_tier", "from_population_log", (F.col("to_tier") - F.col("from_tier")).alias("tier_diff")]
    out += [finite(F.col(c)).alias(c) for c in ("migrant_stock_from_to", "geo_distance", "dialect_distance")]
    out += [(province(F.col("from_city")) == province(F.col("to_city"))).cast("int").alias("is_same_province")]
    return compiled_in_parts(pairs.select("yr", "from_city", "to_city", *out))


def pair_features_earlier(pairs: DataFrame, cities: DataFrame, edges: DataFrame, ratios: list[str]) -> DataFrame:
    """The earlier form on given pairs: -1 for an unknown distance, smoothed ratios."""
    joined = with_ends(with_edges(pairs, edges, -1.0), cities)
    out = {f"{c}_ratio": smoothed_ratio(F.col(f"to_{c}"), F.col(f"from_{c}")) for c in ratios}
    joined = joined.withColumns(out | {"is_same_province": (province(F.col("from_city")) == province(F.col("to_city"))).cast("int"), "city_hit": F.col("to_tier").isNotNull()})
    return joined.drop(*[c for c in joined.columns if c.startswith(("from_", "to_")) and c not in ("from_city", "to_city")])


def match_rates(df: DataFrame, *flags: str) -> DataFrame:
    return df.agg(*[F.avg(F.col(c).cast("double")).alias(f"{c}_rate") for c in flags])


def join_pairs(base: DataFrame, pairs: DataFrame, fill: bool = True) -> DataFrame:
    """A candidate's pair features; an unknown pair is null, or 0 with `fill`."""
    joined = base.join(pairs, ["yr", "from_city", "to_city"], "left")
    return joined.fillna(0, [c for c in pairs.columns if c not in ("yr", "from_city", "to_city")]) if fill else joined


def nearest_year(requests: DataFrame, cities: DataFrame) -> DataFrame:
    """Attributes of the year next to each requested one (yr), the earlier of two as near.

    An as-of merge: requested and known years, a row each, stand in one order, in which each looks
    back and ahead for the next known one.
    """
    known = cities.select("yr", F.col("yr").alias("own_yr"), F.lit(False).alias("asked")).distinct()
    both = known.unionByName(requests.select("yr", F.lit(None).cast("int").alias("own_yr"), F.lit(True).alias("asked")).distinct())
    order = Window.partitionBy(F.lit(0)).orderBy("yr")  # years only
    before = F.last("own_yr", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("own_yr", ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing))
    both = both.withColumns({"before": before, "after": after})
    nearer = F.when(F.col("yr") - F.col("before") <= F.col("after") - F.col("yr"), F.col("before")).otherwise(F.coalesce("after", "before"))
    near = both.select("yr", "asked", nearer.alias("own_yr")).where("asked and own_yr is not null").drop("asked")
    return near.join(cities.withColumnRenamed("yr", "own_yr"), "own_yr")


#: What base rows and pair features are bucketed by.
PAIR = ("yr", "from_city", "to_city")


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """A table dealt by the pair into buckets, each sorted by it: two such tables of as many buckets join
    bucket by bucket, so a lookup moves no row, however large they are."""
    df.repartition(buckets, *PAIR).write.mode("overwrite").bucketBy(buckets, *PAIR).sortBy(*PAIR).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
