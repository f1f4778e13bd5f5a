"""Every registered query of the library and its SQL.

A query is a function of the fixtures, registered with the types of its columns (i: integer, d:
number rounded to six digits, s: string) and, where there is one, SQL over the same fixtures; both
sides are cast by these types.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import cities as ct
from tributary.functions import features as feat
from tributary.functions import labels as lab
from tributary.functions import typeid as tid
from tributary.operators import candidates as cand
from tributary.operators import history as hist
from tributary.operators import metrics as met
from tributary.operators import pairs as pr
from tributary.operators import ranking as rk
from tributary.operators import sampling as smp
from tributary.operators.numbering import numbered
from tributary.plans import learn, pipelines
from tributary.plans.fixtures import WITH, Fixtures, forget_at_exit, shared_folder
from tributary.sources import tables as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WAGES, VACANCIES = [f"wage_{k}_ratio" for k in range(4)], [f"vacancy_{k}_ratio" for k in range(4)]
#: What a city has beside tier, population, income and housing, and what each of its four sectors has.
MORE = ["area_sqkm", "cpi_index", "unemployment_rate", "rent_avg", "daily_cost_index", "medical_score", "education_score", "transport_convenience", "avg_commute_mins", *[f"age_{a}" for a in src.AGES], "sex_ratio"]
OF_SECTOR = [f"{v}_{k}" for v in ("share", "wage", "vacancy") for k in range(4)]
RATIOS = ["population_total", "gdp_per_capita", "housing_price_avg", *OF_SECTOR, *MORE]
DIFFS = ["gdp_per_capita", "housing_price_avg", "rent_avg", *[f"{v}_{k}" for v in ("wage", "vacancy") for k in range(4)]]
HARD = [1000, 1206, 1307]
PAIR_COLUMNS = [f"{c}_ratio" for c in RATIOS] + [f"{c}_diff" for c in DIFFS] + ["to_tier", "to_population_log", "to_gdp_per_capita", "from_tier", "from_population_log", "tier_diff", "migrant_stock_from_to", "geo_distance", "dialect_distance", "is_same_province"]
CODES = list(tid.DIMENSIONS)
CROSS = ["industry_wage_ratio", "industry_vacancy_ratio", "education_tier", "income_gdp", "age_housing", "family_population"]
_CAST = {"i": "bigint", "d": "double", "s": "string"}


def query(types: str, sql: str | None = None):
    """types: `name:kind` by blanks."""
    columns = [c.split(":") for c in types.split()]

    def register(f: Callable[[Fixtures], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Fixtures(spark, sf_dir))
            return df.select(*[(F.round(F.col(c).cast("double") + 1e-9, 6) + 0.0 if k == "d" else F.col(c).cast(_CAST[k])).alias(c) for c, k in columns])

        QUERIES[f.__name__] = run
        if sql:
            cast = [(f"round(cast({c} as double) + 1e-9, 6) + 0.0" if k == "d" else f"cast({c} as {_CAST[k]})") + f" as {c}" for c, k in columns]
            ORACLES[f.__name__] = f"{WITH},\n{_VIEWS}\nselect {', '.join(cast)} from ({sql}) as result_"
        return f

    return register


# What several queries need, as SQL and as DataFrames.


def _ratio(c: str) -> str:
    return f"least(greatest(t.{c} / case when abs(f.{c}) < 1e-9 then 1e-9 else f.{c} end, 0.01), 100) as {c}_ratio"


def _codes(part: str, lenient: bool = True) -> str:
    out = []
    for k, (name, codes) in enumerate(tid.DIMENSIONS.items()):
        cases = " ".join(f"when '{c}' then {n}" for n, c in enumerate(codes))
        value = f"case {part.format(k + 1)} {cases} end"
        out.append(f"coalesce({value}, 0) as {name}" if lenient else f"{value} as {name}")
    return ", ".join(out)


_PART = "split_part(type_id, '_', {})"
_MD5 = "md5(concat_ws(':', '42', cast(yr as string), type_id, cast(to_city as string)))"
_QMD5 = "md5(concat_ws(':', '42', cast(yr as string), type_id))"
_VIEWS = f"""x_attr as (select a.yr, a.city_id, a.tier, a.population_total, a.gdp_per_capita, a.housing_price_avg, {', '.join(f'coalesce(m.{c}, 0) as {c}' for c in MORE)},
  {', '.join(f'coalesce({c}, 0) as {c}' for c in OF_SECTOR)}
  from fx_city_attr a left join fx_city_more m on m.yr = a.yr and m.city_id = a.city_id
  left join (select yr, city_id, {', '.join(f"max(case when ind = {c[-1]} then {c[:-2]} end) as {c}" for c in OF_SECTOR)} from fx_sector group by 1, 2) s on s.yr = a.yr and s.city_id = a.city_id),
x_pairs as (select f.yr, f.city_id as from_city, t.city_id as to_city, {', '.join(map(_ratio, RATIOS))},
  {', '.join(f'least(greatest(t.{c} - f.{c}, -1e8), 1e8) as {c}_diff' for c in DIFFS)},
  t.tier as to_tier, ln(1 + t.population_total) as to_population_log, t.gdp_per_capita as to_gdp_per_capita, f.tier
  as from_tier,
  ln(1 + f.population_total) as from_population_log, t.tier - f.tier as tier_diff, coalesce(m.share, 0) as migrant_stock_from_to,
  coalesce(e.w_geo, 0) as geo_distance, coalesce(e.w_dialect, 0) as dialect_distance,
  case when floor(f.city_id / 100) = floor(t.city_id / 100) then 1 else 0 end as is_same_province
  from x_attr f join x_attr t on f.yr = t.yr and f.city_id <> t.city_id
  left join fx_edges e on e.source_id = f.city_id and e.target_id = t.city_id
  left join fx_migrant m on m.yr = t.yr and m.to_city = t.city_id and m.province = cast(cast(floor(f.city_id / 100)
  as int) * 100 as string)),
x_ranked as (select *, row_number() over (partition by yr, type_id order by score desc, to_city) as pos
  from fx_scores),
x_judged as (select t.yr, t.type_id, t.rnk, t.to_city, p.pos, row_number() over (partition by t.yr, t.type_id order by t.rnk)
  as ideal,
  power(2, 21 - t.rnk) - 1 as gain, sum(case when p.pos is not null then 1 else 0 end) over (partition by t.yr, t.type_id
  order by p.pos nulls last rows unbounded preceding) as so_far
  from fx_truth t left join x_ranked p on p.yr = t.yr and p.type_id = t.type_id and p.to_city = t.to_city),
x_queries as (select yr, type_id, from_city, row_number() over (partition by yr order by {_QMD5}, type_id) as k, count(*)
  over (partition by yr) as n
  from (select distinct yr, type_id, from_city from fx_base) q),
x_positive as (select yr, type_id, row_number() over (partition by yr order by {_QMD5}, type_id) as k, count(*)
  over (partition by yr) as n
  from (select distinct yr, type_id from fx_truth) q),
x_label as (select *, case when rnk between 1 and 20 then 1 else 0 end as label
  from fx_base),
x_hard as (select *, to_city in ({', '.join(map(str, HARD))}) or floor(from_city / 100) = floor(to_city / 100)
  as hard from x_label),
x_kept as (select * from (select *, sum(case when rnk = 0 and not hard then 1 else 0 end) over (partition by yr, type_id)
  as rest,
  cast(concat('0x', substr({_MD5}, 1, 8)) as bigint) / 4294967296.0 as u
  from x_hard) h where rnk > 0 or hard or u < least(1.0, 10.0 / greatest(rest, 1)))"""


def _feature_sql(base: str, keep: str) -> str:
    """SQL that joins person codes, pair features and cross features to rows b."""
    pick = lambda v: "case industry " + " ".join(f"when {k} then coalesce(p.{v}_{k}_ratio, 0)" for k in range(4)) + " end"
    pairs = ", ".join(f"coalesce(p.{c}, 0) as {c}" for c in PAIR_COLUMNS)
    return f"""select {keep}, {', '.join(CODES)}, {pairs}, {pick('wage')} as industry_wage_ratio, {pick('vacancy')} as industry_vacancy_ratio,
  education * coalesce(p.tier_diff, 0) as education_tier, income * coalesce(p.gdp_per_capita_ratio, 0) as income_gdp,
  age_group * coalesce(p.housing_price_avg_ratio, 0) as age_housing, family * coalesce(p.population_total_ratio, 0) as family_population
  from (select *, {_codes(_PART)} from ({base}) b0) b left join x_pairs p on p.yr = b.yr and p.from_city = b.from_city and p.to_city = b.to_city"""


_FEATURES = " ".join([f"{c}:i" for c in CODES] + [f"{c}:d" for c in PAIR_COLUMNS + CROSS])
_KEYS = "yr:i type_id:s from_city:i to_city:i"


def attributes(fx: Fixtures) -> DataFrame:
    by = fx.sector.groupBy("yr", "city_id").agg(*[F.max(F.when(F.col("ind") == int(c[-1]), F.col(c[:-2]))).alias(c) for c in OF_SECTOR])
    return fx.city_attr.join(fx.city_more, ["yr", "city_id"], "left").join(by, ["yr", "city_id"], "left").fillna(0.0, MORE + OF_SECTOR)


def migrants(fx: Fixtures) -> DataFrame:
    return fx.migrant.groupBy("yr", "to_city").agg(F.map_from_entries(F.collect_list(F.struct("province", "share"))).alias("stock"))  # a few provinces a city


def pairs(fx: Fixtures) -> DataFrame:
    return pr.pair_features(attributes(fx), fx.edges, migrants(fx), RATIOS, DIFFS)


def ranks(fx: Fixtures) -> DataFrame:
    return rk.ranked(fx.scores)


def city_json(fx: Fixtures) -> DataFrame:
    """Nested yearly city lines with every attribute, and holes: a sector of even cities, an age of every fifth,
    the sex ratio of two in three."""
    s = fx.sector.groupBy("yr", "city_id").agg(F.map_from_entries(F.collect_list(F.struct(F.get(F.array(*map(F.lit, src.SECTORS)), F.col("ind")).alias("k"), F.struct("share", F.col("wage").alias("avg_wage"), F.col("vacancy").alias("vacancy_rate"))))).alias("sectors"))
    a = fx.city_attr.join(fx.city_more, ["yr", "city_id"]).join(s, ["yr", "city_id"], "left").join(migrants(fx).withColumnRenamed("to_city", "city_id"), ["yr", "city_id"], "left")
    sectors = F.map_filter("sectors", lambda k, v: ~((k == "agriculture") & (F.col("city_id") % 2 == 0)))
    ages = F.map_filter(F.create_map(*[x for g in src.AGES for x in (F.lit(g), F.col(f"age_{g}"))]), lambda k, v: ~((k == "65_plus") & (F.col("city_id") % 5 == 0)))
    value = F.struct(
        F.col("city_id").cast("string").alias("city_id"),
        F.struct("tier", "area_sqkm").alias("basic_info"),
        F.struct("gdp_per_capita", "cpi_index", "unemployment_rate", sectors.alias("industry_sectors")).alias("economy"),
        F.struct(ages.alias("age_structure"), F.when(F.col("city_id") % 3 == 0, F.col("sex_ratio")).alias("sex_ratio")).alias("demographics"),
        F.struct("housing_price_avg", "rent_avg", "daily_cost_index").alias("living_cost"),
        F.struct("medical_score", "education_score", "transport_convenience", "avg_commute_mins").alias("public_services"),
        F.struct("population_total", F.col("stock").alias("migrant_stock_distribution")).alias("social_context"),
    )
    return a.select("yr", F.to_json(value).alias("value"))


def list_lines(fx: Fixtures) -> DataFrame:
    """Candidate lists of both shapes, by the origin's parity."""
    lists = rk.as_lists(rk.top_k(fx.scores, 10)).withColumn("odd", F.element_at(F.split("type_id", "_"), -1).cast("int") % 2)
    plain, held = F.to_json(F.create_map("type_id", "cities")), F.to_json(F.create_map("type_id", F.struct(F.col("cities").alias("top_cities"))))
    return lists.select("yr", F.when(F.col("odd") == 1, held).otherwise(plain).alias("value"))


# Headline: last year's flows as a forecast.


@query("yr:i n_queries:i mean_gt:d recall_5:d recall_10:d recall_20:d", """select yr, count(*) as n_queries, avg(gt) as mean_gt, avg(h5 / cast(least(5, gt) as double)) as recall_5, avg(h10 / cast(least(10, gt)
  as double)) as recall_10, avg(h20 / cast(least(20, gt) as double)) as recall_20
from (select yr, type_id, count(*) as gt, sum(case when pos <= 5 then 1 else 0 end) as h5, sum(case when pos <= 10 then 1 else 0 end)
  as h10, sum(case when pos <= 20 then 1 else 0 end) as h20 from x_judged
  group by 1, 2) g group by rollup (yr)""")  # fmt: skip
def recall_by_year(fx):
    return met.by_year(met.judged(ranks(fx), fx.truth, (5, 10, 20), "least"), "recall_5", "recall_10", "recall_20")


# Sources.


@query("type_id:s To_Top1:s To_Top2:s To_Top20:s", "select type_id, To_Top1, To_Top2, To_Top20 from fx_wide where yr = 1997")
def fact_scan(fx):
    return src.scan_facts(fx.wide, 1997)


@query("yr:i n_rows:i", "select yr, count(*) as n_rows from fx_wide group by yr")
def fact_rows_per_year(fx):
    return src.rows_per_year(fx.wide)


@query("from_city:i to_city:i gdp_per_capita_ratio:d tier_diff:i", "select from_city, to_city, gdp_per_capita_ratio, tier_diff from x_pairs where yr = 1998")
def pair_scan(fx):
    return src.scan_columns(pairs(fx), 1998, "from_city", "to_city", "gdp_per_capita_ratio", "tier_diff")


@query("type_id:s to_city:i rnk:i", "select type_id, to_city, rnk from fx_base where yr = 1996")
def base_scan(fx):
    return src.scan_columns(fx.base, 1996, "type_id", "to_city", "rnk")


_FLAT = ["area_sqkm", "gdp_per_capita", "cpi_index", "unemployment_rate", "housing_price_avg", "rent_avg", "daily_cost_index", "medical_score", "education_score", "transport_convenience", "avg_commute_mins", "population_total"]
_SECTORAL = {f"{s}_{v}": f"{o}_{k}" for k, s in enumerate(src.SECTORS) for v, o in (("share", "share"), ("avg_wage", "wage"), ("vacancy_rate", "vacancy"))}
_NESTED = f"""select yr, city_id, tier, {', '.join(_FLAT)}, {', '.join(f"case when city_id % 2 = 0 then 0 else {o} end as {c}" if o.endswith('_0') else f'{o} as {c}' for c, o in _SECTORAL.items())},
  {', '.join(f'age_{a}' for a in src.AGES[:-1])}, case when city_id % 5 = 0 then 0 else age_65_plus end as age_65_plus, case when city_id % 3 = 0 then sex_ratio else 100 end as sex_ratio from x_attr"""
_NESTED_TYPES = "yr:i city_id:i tier:i " + " ".join(f"{c}:d" for c in [*_FLAT, *_SECTORAL, *[f"age_{a}" for a in src.AGES], "sex_ratio"])


@query(_NESTED_TYPES, _NESTED)
def nested_city_scan(fx):
    return src.city_attributes(city_json(fx))


@query(_NESTED_TYPES, f"select * from ({_NESTED}) n where yr = 1999")
def nested_city_year(fx):
    return src.city_attributes(city_json(fx)).where("yr = 1999")


_SECTORAL_OLD = {c.replace("avg_wage", "wage"): o for c, o in _SECTORAL.items() if not o.startswith("vacancy")}


@query("yr:i city_id:i tier:i " + " ".join(f"{c}:d" for c in [*_FLAT, *_SECTORAL_OLD]), f"""select yr, city_id, tier, {', '.join(_FLAT)},
  {', '.join(f"case when city_id % 2 = 0 then 0 else {o} end as {c}" if o.endswith('_0') else f'{o} as {c}' for c, o in _SECTORAL_OLD.items())} from x_attr""")  # fmt: skip
def nested_city_earlier(fx):
    """The earlier flavour, all years of a folder in one call; a year without a file is not there."""
    path = fresh(fx, "cities")
    src.write_lines(city_json(fx), path)
    return src.city_attributes_earlier(src.read_lines(fx.spark, path))


@query("source_id:i target_id:i w_geo:d w_dialect:d", "select distinct source_id, target_id, w_geo, w_dialect from fx_edges")
def edge_scan(fx):
    return src.edges(fx.edges.select(F.col("source_id").cast("string"), F.col("target_id").cast("string"), "w_geo", "w_dialect"))


@query("city_id:i city_name:s", "select city_id, city_name from fx_city")
def node_scan(fx):
    lines = fx.city.select(F.to_json(F.struct(F.col("city_id").cast("string").alias("city_id"), F.col("city_name").alias("name"))).alias("value"))
    return src.nodes(lines.union(lines.limit(1).select(F.lit("  "))))


@query("what:s n:i", """select 'attributes' as what, count(*) as n from fx_city_attr union all select 'edges', count(*)
  from fx_edges union all select 'nodes', count(*) from fx_city""")
def city_tables(fx):
    held = {"attributes": src.city_attributes(city_json(fx)), "edges": src.edges(fx.edges), "nodes": fx.city}
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, df in held.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query("city_id:i first_place:i", """select cast(split_part(type_id, '_', 7) as int) as city_id, min(place) as first_place
  from (select type_id, row_number() over (order by type_id) as place from (select distinct type_id
  from fx_flows) d) t group by 1""")
def type_list_cities(fx):
    ids = fx.flows.select(F.col("type_id").alias("id")).distinct()  # a test list; its order is by id
    return src.listed_cities(numbered(ids, (), F.substring("id", 1, 20), "id", into="place"))


_LISTS = "select yr, type_id, string_agg(cast(to_city as string), ',' order by pos) as cities from x_ranked where pos <= {} group by yr, type_id"


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("cities", F.array_join(F.transform("cities", lambda c: c.cast("string")), ","))


@query("yr:i type_id:s cities:s", _LISTS.format(5))
def candidate_list_scan(fx):
    return _joined(src.candidate_lists(list_lines(fx), 5))


@query("yr:i type_id:s cities:s", _LISTS.format(10))
def prediction_list_scan(fx):
    return _joined(src.candidate_lists(list_lines(fx), None))


@query("yr:i n_rows:i", "select yr, count(*) as n_rows from fx_base where yr in (1995, 1998) group by yr")
def missing_years_skipped(fx):
    return src.rows_per_year(src.years_present(fx.base, [1990, 1995, 1998]))


# Sinks.


@query("yr:i value:s", """select yr, concat('{\"', type_id, '\":[', string_agg(cast(to_city as string), ',' order by pos), ']}') as value
  from x_ranked where pos <= 100 group by yr, type_id""")
def candidate_lines(fx):
    return src.json_lines(rk.as_lists(rk.top_k(fx.scores, 100)), 100)


@query("yr:i value:s", """select yr, concat('{\"', type_id, '\":[', string_agg(cast(to_city as string), ',' order by pos), ']}') as value
  from x_ranked where pos <= 8 group by yr, type_id""")
def ranked_lines(fx):
    return src.json_lines(rk.as_lists(rk.ranked(fx.scores)), 8)


@query("yr:i value:s", """select yr, concat('{\"', type_id, '\":[', string_agg(cast(to_city as string), ',' order by pos), ']}') as value
  from x_ranked where pos <= 20 group by yr, type_id""")
def export_reencoded(fx):
    lists = rk.as_lists(rk.top_k(fx.scores, 20))
    return src.json_lines(tid.parse(lists).withColumn("type_id", tid.encoded()), 20)


@query("yr:i total:i unique_keys:i repeated:i", """select yr, sum(n) as total, count(*) as unique_keys, sum(case when n > 1 then 1 else 0 end) as repeated
  from (select yr, type_id, count(*) as n from (select yr, type_id, pos
  from x_ranked) d group by 1, 2) k group by yr""")
def export_key_check(fx):
    return src.repeated_keys(ranks(fx))


def fresh(fx: Fixtures, name: str) -> str:
    """A folder of its own that all executors share, for as long as the application runs."""
    return forget_at_exit(fx.spark, f"{shared_folder(fx.spark)}/{name}-{uuid.uuid4().hex}")


@query("yr:i value:s", """select yr, concat('{"', type_id, '":[', string_agg(cast(to_city as string), ',' order by pos), ']}') as value
  from x_ranked where pos <= 40 group by yr, type_id""")
def export_written(fx):
    """Written under re-encoded type ids in a folder a year, and read back."""
    lists = rk.as_lists(rk.top_k(fx.scores, 40))
    path = fresh(fx, "export")
    src.write_lines(src.json_lines(tid.parse(lists).withColumn("type_id", tid.encoded()), 40), path)
    return src.read_lines(fx.spark, path)


@query("yr:i from_city:i to_city:i " + " ".join(f"{c}:d" for c in PAIR_COLUMNS), "select * from x_pairs")
def pair_features_written(fx):
    path = fresh(fx, "pairs")
    src.write_years(pairs(fx), path)
    return fx.spark.read.parquet(path)


@query("yr:i n:i", "select yr, count(*) as n from fx_base where yr >= 1997 group by yr")
def output_reset(fx):
    """A build that begins anew leaves nothing of the one before."""
    path = fresh(fx, "built")
    src.write_years(fx.base.where("yr < 1999"), path)
    src.write_years(fx.base.where("yr >= 1997"), path, reset=True)
    return fx.spark.read.parquet(path).groupBy("yr").agg(F.count("*").alias("n"))


# Type ids and cities.


@query("type_id:s " + " ".join(f"{c}:i" for c in CODES) + " from_city:i parse_ok:i", f"select distinct type_id, {_codes(_PART)}, from_city, 1 as parse_ok from fx_flows")
def type_parse(fx):
    return tid.parse(fx.flows.select("type_id").distinct())


@query("type_id:s " + " ".join(f"{c}:i" for c in CODES) + " from_city:i", f"select distinct type_id, {_codes(_PART)}, from_city from fx_flows")
def type_parse_strict(fx):
    return tid.parse_strict(fx.flows.select("type_id").distinct())


_VARIANT_SQL = """select distinct case from_city % 5 when 1 then array_to_string(list_slice(string_split(type_id, '_'), 1, 6), '_')
  when 2 then array_to_string(list_slice(string_split(type_id, '_'), 1, 5), '_') when 3 then regexp_replace(type_id, '^(.)_..', '\\1_99') else type_id end
  as type_id, from_city as origin from fx_flows"""


def _variants(fx: Fixtures) -> DataFrame:
    return fx.flows.selectExpr("case from_city % 5 when 1 then array_join(slice(split(type_id, '_'), 1, 6), '_') when 2 then array_join(slice(split(type_id, '_'), 1, 5), '_') when 3 then regexp_replace(type_id, '^(.)_..', '$1_99') else type_id end as type_id", "from_city as origin").distinct()


@query("type_id:s origin:i from_city:i parse_ok:i", f"""select type_id, origin, case when origin % 5 = 2 then null else origin end as from_city, case when origin % 5 in (2, 3) then 0 else 1 end
  as parse_ok from ({_VARIANT_SQL}) v""")
def type_parse_variants(fx):
    return tid.parse(_variants(fx), origin="origin")


@query("type_id_orig:s " + " ".join(f"{c}:i" for c in CODES), f"select type_id as type_id_orig, {_codes(_PART)} from ({_VARIANT_SQL}) v")
def type_parse_lenient(fx):
    return tid.parse_lenient(_variants(fx))


@query("type_id:s again:s", "select distinct type_id, type_id as again from fx_flows")
def type_round_trip(fx):
    return tid.parse(fx.flows.select("type_id").distinct()).withColumn("again", tid.encoded())


_TEXTS = "case city_id % 4 when 0 then cast(city_id as string) when 1 then concat(city_name, '(', cast(city_id as string), ')') when 2 then concat(' ', cast(city_id as string), ' ') else concat('x', cast(tier as string), 'y', cast(city_id as string)) end"


@query("txt:s city:i robust:i safe:i", f"""select txt, coalesce(try_cast(regexp_extract(txt, '\\((\\d+)\\)', 1) as int), try_cast(txt as int)) as city, city_id
  as robust, coalesce(try_cast(txt as int), -1) as safe from (select {_TEXTS} as txt, city_id
  from fx_city) t""")
def city_texts(fx):
    t = fx.city.selectExpr(f"{_TEXTS} as txt")
    return t.withColumns({"city": ct.city_id(F.col("txt")), "robust": ct.city_id_robust(F.col("txt")), "safe": ct.safe_int(F.col("txt"))})


@query("yr:i type_id:s rnk:i to_city:i n:i", "select yr, type_id, rnk, to_city, n from fx_truth")
def wide_to_long(fx):
    return src.wide_to_long(fx.wide, ct.city_id(F.col("to_text")))


@query("yr:i type_id:s to_1:i to_2:i to_20:i", """select yr, type_id, max(case when rnk = 1 then to_city end) as to_1, max(case when rnk = 2 then to_city end) as to_2,
  max(case when rnk = 20 then to_city end) as to_20 from fx_truth group by 1, 2""")
def long_to_wide(fx):
    return src.long_to_wide(fx.truth)


@query("yr:i type_id:s to_city:i city_name:s", "select yr, type_id, to_city, city_name from fx_truth join fx_city on to_city = city_id")
def city_names(fx):
    return ct.with_names(fx.truth, fx.city)


@query("city_name:s city_id:i", "select city_name, city_id from fx_city")
def city_ids_by_name(fx):
    return ct.ids_of(fx.city.select("city_name"), fx.city)


@query("source_id:i target_id:i w_geo:d gdp_per_capita:d", """select f.city_id as source_id, t.city_id as target_id, e.w_geo, a.gdp_per_capita
  from fx_city f join fx_city t on t.tier = f.tier left join fx_edges e on e.source_id = f.city_id and e.target_id = t.city_id
  left join fx_city_attr a on a.city_id = f.city_id and a.yr = 1997""")
def point_lookups(fx):
    """Many requests for an edge and a city's attributes at once."""
    want = fx.city.select(F.col("city_id").alias("source_id"), "tier").join(fx.city.select(F.col("city_id").alias("target_id"), "tier"), "tier")
    own = fx.city_attr.where("yr = 1997").select(F.col("city_id").alias("source_id"), "gdp_per_capita")
    return want.join(fx.edges, ["source_id", "target_id"], "left").join(own, "source_id", "left")


# Pairs and features.


@query("yr:i from_city:i to_city:i " + " ".join(f"{c}:d" for c in PAIR_COLUMNS), "select * from x_pairs")
def pair_features(fx):
    return pairs(fx)


_EARLIER = [c for c in ("population_total", "gdp_per_capita", "housing_price_avg")]


@query("yr:i from_city:i to_city:i geo_distance:d dialect_distance:d is_same_province:i " + " ".join(f"{c}_ratio:d" for c in _EARLIER), f"""select b.yr, b.from_city, b.to_city, coalesce(e.w_geo, -1) as geo_distance, coalesce(e.w_dialect, -1) as dialect_distance,
  case when floor(b.from_city / 100) = floor(b.to_city / 100) then 1 else 0 end as is_same_province,
{', '.join(f'least(greatest(case when f.{c} > 1e-5 then coalesce(t.{c}, 0) / (f.{c} + 1e-5) else 1 end, 0.1), 10) as {c}_ratio' for c in _EARLIER)}
from (select distinct yr, from_city, to_city from fx_base) b left join fx_city_attr f on f.yr = b.yr and f.city_id = b.from_city
  left join fx_city_attr t on t.yr = b.yr and t.city_id = b.to_city left
  join fx_edges e on e.source_id = b.from_city and e.target_id = b.to_city""")  # fmt: skip
def pair_features_earlier(fx):
    return pr.pair_features_earlier(fx.base.select("yr", "from_city", "to_city").distinct(), fx.city_attr, fx.edges, _EARLIER)


@query("edge_hit_rate:d city_hit_rate:d", """select avg(case when e.w_geo is not null then 1.0 else 0.0 end) as edge_hit_rate, avg(case when t.tier is not null then 1.0 else 0.0 end)
  as city_hit_rate from (select distinct yr, from_city, to_city from fx_base) b
  left join fx_city_attr t on t.yr = b.yr and t.city_id = b.to_city left
  join fx_edges e on e.source_id = b.from_city and e.target_id = b.to_city""")
def match_rates(fx):
    return pr.match_rates(pr.pair_features_earlier(fx.base.select("yr", "from_city", "to_city").distinct(), fx.city_attr, fx.edges, _EARLIER), "edge_hit", "city_hit")


@query(f"{_KEYS} rnk:i {_FEATURES}", _feature_sql("select * from fx_base", "b.yr, b.type_id, b.from_city, b.to_city, b.rnk"))
def cross_features(fx):
    return pipelines.with_features(fx.base, pairs(fx), WAGES, VACANCIES)


@query("yr:i from_city:i to_city:i tier_diff:d geo_distance:d", """select b.yr, b.from_city, b.to_city, p.tier_diff, p.geo_distance from (select distinct yr, from_city, to_city
  from fx_base) b left join x_pairs p on p.yr = b.yr and p.from_city = b.from_city and p.to_city = b.to_city""")
def base_join_pairs(fx):
    return pr.join_pairs(fx.base.select("yr", "from_city", "to_city").distinct(), pairs(fx), fill=False)


@query("yr:i city_id:i tier:i population_total:i gdp_per_capita:d", """select yr, city_id, tier, population_total, cast(gdp_per_capita as float) as gdp_per_capita
  from fx_city_attr""")
def downcast_values(fx):
    return feat.downcast(fx.city_attr)


_ALL = CODES + PAIR_COLUMNS + CROSS


@query("column_name:s n:i low:d high:d", f"""with f as materialized ({_feature_sql("select * from fx_base", "b.yr")})
  {" union all ".join(f"select '{c}' as column_name, count({c}) as n, min({c}) as low, max({c}) as high from f" for c in _ALL)}""")
def feature_list(fx):
    """The columns that a model is given, chosen from the wide rows, with how many values each has and between what."""
    df = pipelines.with_features(fx.base, pairs(fx), WAGES, VACANCIES)
    return feat.profile(df, feat.feature_columns(df))


@query("column_name:s there:i lacking:i", f"""{" union all ".join(f"select '{c}' as column_name, 1 as there, count(*) - count({c}) as lacking from fx_scores" for c in ("yr", "type_id", "from_city", "to_city", "rnk", "score"))}
  union all select 'n', 0, count(*) from fx_scores union all select 'distance', 0, count(*) from fx_scores""")
def missing_columns(fx):
    """Of the columns that a transform needs: which are there, and in how many rows a value is lacking."""
    return feat.lacking(fx.scores, "yr", "type_id", "from_city", "to_city", "rnk", "score", "n", "distance")


@query(f"{_KEYS} n:i rnk:i label:i tier_diff:i", """select b.yr, b.type_id, b.from_city, b.to_city, 0 as n, 999 as rnk, 0 as label, coalesce(p.tier_diff, 0) as tier_diff
  from fx_base b left join x_pairs p on p.yr = b.yr and p.from_city = b.from_city and p.to_city = b.to_city""")
def transform_predict(fx):
    return pipelines.transform(fx.base.drop("rnk"), pairs(fx), None, WAGES, VACANCIES, "predict")


@query("want:i own_yr:i city_id:i population_total:d", """select want, a.yr as own_yr, city_id, population_total from (select want, own, row_number() over (partition by want
  order by abs(own - want), own) as k from (values (1990), (1996), (1998), (2010)) w(want) cross
  join (select distinct yr as own from fx_city_attr where yr <> 1998) y) n
  join fx_city_attr a on a.yr = n.own where k = 1""")
def nearest_year(fx):
    want = fx.city_attr.select(F.explode(F.array(*map(F.lit, (1990, 1996, 1998, 2010)))).alias("yr")).distinct()
    return pr.nearest_year(want, fx.city_attr.where("yr <> 1998")).withColumnRenamed("yr", "want")


# Labels and weights.


@query("rnk:i a:i b:i c:i d:d e:i w1:i w2:i w3:i g:d l:i", """select distinct rnk, case when rnk between 1 and 20 then 1 else 0 end as a, case when rnk between 1 and 10 then 12 - rnk
  when rnk between 11 and 20 then 1 else 0 end as b, case when rnk between 1 and 20 then 21 - rnk else 0 end as c,
case when rnk between 1 and 10 then 1.0 when rnk between 11 and 20 then 0.1 else 0 end as d, case when rnk between 1
  and 10 then 1 else 0 end as e, case when rnk between 1 and 5 then 40 when rnk between 6 and 20 then 30 else 1 end
  as w1,
case when rnk between 1 and 3 then 50 when rnk between 4 and 10 then 35 when rnk between 11 and 20 then 24 else 1 end
  as w2, case when rnk between 1 and 10 then 20 when rnk between 11 and 20 then 5 else 1 end as w3,
case when rnk between 1 and 20 then power(2, 21 - rnk) - 1 else 0 end as g, [0, 1, 3, 5, 7, 10, 14, 19, 25, 32, 40, 50][case
  when rnk between 1 and 10 then 12 - rnk when rnk between 11 and 20 then 1 else 0 end + 1] as l
  from fx_base""")  # fmt: skip
def label_table(fx):
    r = F.col("rnk")
    return fx.base.select("rnk").distinct().withColumns({"a": lab.binary(r), "b": lab.graded_short(r), "c": lab.graded(r), "d": lab.three_level(r), "e": lab.hard_label(r), "w1": lab.weight_recall(r), "w2": lab.weight_steep(r), "w3": lab.weight_level(r), "g": lab.gain(r), "l": lab.listed_gain(lab.graded_short(r))})


@query("yr:i label:i n:i weight:d", """select yr, label, count(*) as n, sum(case when rnk between 1 and 5 then 40 when rnk between 6 and 20 then 30 else 1 end)
  as weight from x_label group by 1, 2""")
def label_weights_by_year(fx):
    r = F.col("rnk")
    return fx.base.groupBy("yr", lab.binary(r).alias("label")).agg(F.count("*").alias("n"), F.sum(lab.weight_recall(r)).alias("weight"))


@query("yr:i w:d", "select distinct yr, power(0.9, (select max(yr) from fx_base) - yr) as w from fx_base")
def time_decay(fx):
    years = fx.base.select("yr").distinct()
    at = years.crossJoin(years.agg(F.max("yr").alias("last")))  # one row
    return at.withColumn("w", lab.decay(F.col("yr"), F.col("last")))


# Filters and samples.


@query(_KEYS, """select b.yr, b.type_id, b.from_city, b.to_city from (select q.yr, q.type_id, q.from_city, c.city_id as to_city
  from (select distinct yr, type_id, from_city from fx_flows) q cross join fx_city c) b
  where to_city <> from_city and to_city in (select from_city from x_pairs union select to_city
  from x_pairs)""")
def known_candidates(fx):
    queries = fx.flows.select("yr", "type_id", "from_city").distinct()
    return cand.keep_known(cand.drop_self(cand.expand(queries, fx.city, include_self=True)), pairs(fx))


@query(_KEYS, "select yr, type_id, from_city, to_city from fx_base b where exists (select 1 from fx_edges e where e.source_id = b.from_city and e.target_id = b.to_city)")
def reachable_candidates(fx):
    roads = fx.edges.select(F.col("source_id").alias("from_city"), F.col("target_id").alias("to_city"))
    return cand.keep_reachable(fx.base, roads)


@query("yr:i city_id:i", "select distinct yr, from_city as city_id from fx_flows")
def origin_pool(fx):
    return cand.origins(fx.flows)


@query(f"{_KEYS} label:i", """select yr, type_id, from_city, to_city, label from (
  select *, max(label) over (partition by yr, type_id) as m from x_label) y where m > 0""")
def queries_with_positive(fx):
    return smp.with_positive(fx.base.withColumn("label", lab.binary(F.col("rnk"))))


@query("yr:i type_id:s to_city:i", "select b.yr, b.type_id, b.to_city from fx_base b join x_queries q on q.yr = b.yr and q.type_id = b.type_id where k <= floor(n * 0.3)")
def sample_share_of_queries(fx):
    return smp.sample_fraction(fx.base, 0.3)


@query("yr:i type_id:s to_city:i", "select b.yr, b.type_id, b.to_city from fx_base b join x_queries q on q.yr = b.yr and q.type_id = b.type_id where k <= 12")
def sample_n_queries(fx):
    return smp.sample_count(fx.base, 12)


@query("yr:i type_id:s", "select yr, type_id from x_queries where k <= greatest(1, floor(n * 0.001))")
def sample_at_least_one(fx):
    return smp.sample_fraction(fx.base.select("yr", "type_id").distinct(), 0.001, least=1)


@query("yr:i type_id:s split:s", "select yr, type_id, case when k <= 40 then 'train' else 'val' end as split from x_queries where k <= 55")
def train_validation_split(fx):
    return smp.split_train_validation(fx.base.select("yr", "type_id").distinct(), 40, 15)


@query("yr:i from_city:i to_city:i", """select yr, from_city, to_city from (select yr, from_city, to_city, row_number() over (partition by yr, from_city
  order by md5(concat_ws(':', '42', cast(yr as string), cast(from_city as string), cast(to_city as string)))) as k, count(*)
  over (partition by yr, from_city) as n from x_pairs) p where k <= greatest(5, floor(n * 0.4))""")
def sample_candidates(fx):
    return smp.sample_candidates(pairs(fx), 0.4, least=5)


@query("yr:i type_id:s", f"""select yr, type_id from (select yr, type_id from fx_truth intersect select yr, type_id
  from fx_scores) c order by {_QMD5}, yr, type_id limit 50""")
def sample_common_queries(fx):
    return smp.sample_common(fx.truth, fx.scores, 50)


@query("yr:i split:s batch:i n:i", """select yr, case when yr <= 1999 then 'train' when yr = 2000 then 'val' else 'test' end as split, cast(floor((yr - 1995) / 3)
  as int) as batch, count(*) as n from fx_base where yr between 1995 and 2001
  group by 1, 2, 3""")
def year_split(fx):
    split = smp.year_batches(smp.split_by_year(fx.base, (1995, 1999), (2000, 2000), (2001, 2001)), 1995)
    return split.groupBy("yr", "split", "batch").agg(F.count("*").alias("n"))


@query("idx:i yr:i type_id:s cities:s", f"""select idx, q.yr, q.type_id, coalesce(l.cities, '') as cities from (select row_number() over (order by yr, type_id)
  as idx, yr, type_id from (select yr, type_id from fx_truth where rnk = 1
  union all select 1900, 'broken') u) q left join ({_LISTS.format(3)}) l on l.yr = q.yr and l.type_id = q.type_id""")
def bad_queries_keep_place(fx):
    asked = fx.truth.where("rnk = 1").select("yr", "type_id").union(fx.city.limit(1).select(F.lit(1900), F.lit("broken")))
    asked = rk.dense_query_numbers(asked).withColumn("idx", F.col("qid") + 1)  # the test's numbering of its requests
    return _joined(cand.in_query_order(asked, rk.as_lists(rk.top_k(fx.scores, 3))))


@query("yr:i type_id:s to_city:i n:i", f"""select yr, type_id, to_city, case when cast(concat('0x', substr({_MD5}, 1, 8)) as bigint) / 4294967296.0 >= 0.25 then n else 0 end
  as n from fx_flows""")
def history_dropout(fx):
    return smp.drop_history(fx.flows, ["n"], 0.25)


@query(f"{_KEYS} rnk:i", f"""select yr, type_id, from_city, to_city, rnk from (select *, row_number() over (partition by yr, type_id, st order by {_MD5})
  as k from (select *, case when rnk > 0 then 0 when to_city in (1000, 1206, 1307) then 1 else 2 end as st
  from fx_base) s) x where st = 0 or (st = 1 and k <= 1) or (st = 2 and k <= 2)""")
def stratified_negatives(fx):
    return smp.stratified_negatives(fx.base, HARD, 1, 2)


@query(f"{_KEYS} rnk:i", "select yr, type_id, from_city, to_city, rnk from x_hard where rnk > 0 or hard")
def hard_negatives(fx):
    return fx.base.where((F.col("rnk") > 0) | smp.is_hard(HARD))


@query(f"{_KEYS} rnk:i", "select yr, type_id, from_city, to_city, rnk from x_kept")
def bernoulli_negatives(fx):
    return smp.keep_share(fx.base, HARD, 10)


@query(f"{_KEYS} rnk:i", f"""select yr, type_id, from_city, to_city, rnk from (select *, row_number() over (partition by yr, type_id, rnk > 0
  order by {_MD5}) as k from fx_base) x where rnk > 0 or k <= 3""")
def exact_negatives(fx):
    return smp.exact_negatives(fx.base, 3)


# Joins.


@query("yr:i n:i own:i", """select yr, count(*) as n, sum(case when to_city = from_city then 1 else 0 end) as own
  from (select q.yr, q.from_city, c.city_id as to_city from (select distinct yr, type_id, from_city
  from fx_flows) q cross join fx_city c) x group by yr""")
def query_city_expansion(fx):
    both = cand.expand(fx.flows.select("yr", "type_id", "from_city").distinct(), fx.city, include_self=True)
    return both.groupBy("yr").agg(F.count("*").alias("n"), F.sum((F.col("to_city") == F.col("from_city")).cast("int")).alias("own"))


@query("from_city:i n:i first_id:s last_id:s", """select city_id as from_city, count(*) as n, min(concat_ws('_', g, a, e, i, c, f, cast(city_id as string))) as first_id,
  max(concat_ws('_', g, a, e, i, c, f, cast(city_id as string))) as last_id
  from fx_city cross join (values ('M'), ('F')) g(g) cross join (values ('20'), ('30'), ('40'), ('55'), ('65')) a(a) cross
  join (values ('EduLo'), ('EduMid'), ('EduHi')) e(e) cross join (values ('Agri'), ('Mfg'), ('Service'), ('Wht')) i(i) cross
  join (values ('IncL'), ('IncML'), ('IncM'), ('IncMH'), ('IncH')) c(c) cross
  join (values ('Split'), ('Unit')) f(f) where city_id in (select from_city
  from x_pairs) group by 1""")
def every_person_and_origin(fx):
    known = fx.city.select(F.col("city_id").alias("from_city")).join(pairs(fx).select("from_city").distinct(), "from_city", "left_semi")
    return tid.every_person(known).groupBy("from_city").agg(F.count("*").alias("n"), F.min("type_id").alias("first_id"), F.max("type_id").alias("last_id"))


@query("yr:i type_id:s to_city:i place:i", """select yr, type_id, to_city, pos as place from x_ranked where pos <= 10 and exists (select 1
  from fx_truth t where t.yr = x_ranked.yr and t.type_id = x_ranked.type_id)""")
def queries_join_lists(fx):
    return cand.from_lists(fx.truth.select("yr", "type_id").distinct(), src.candidate_lists(list_lines(fx)))


@query("yr:i type_id:s to_city:i rnk:i relevance:i", """select r.yr, r.type_id, r.to_city, coalesce(t.rnk, 0) as rnk, case when t.rnk is null then 0 else 21 - t.rnk end
  as relevance from x_ranked r left join fx_truth t on t.yr = r.yr and t.type_id = r.type_id and t.to_city = r.to_city
  where pos <= 15""")
def grade_candidates(fx):
    return cand.with_truth(ranks(fx).where("pos <= 15").drop("rnk"), fx.truth).withColumn("relevance", lab.graded(F.col("rnk")))


@query("yr:i matched:i skipped:i", """select p.yr, sum(case when t.type_id is not null then 1 else 0 end) as matched, sum(case when t.type_id is null then 1 else 0 end)
  as skipped from (select distinct yr, type_id from x_ranked) p left join (select distinct yr, type_id
  from fx_truth) t on t.yr = p.yr and t.type_id = p.type_id
  group by p.yr""")
def predictions_with_truth(fx):
    there = fx.truth.select("yr", "type_id", F.lit(1).alias("hit")).distinct()
    joined = fx.scores.select("yr", "type_id").distinct().join(there, ["yr", "type_id"], "left")
    return joined.groupBy("yr").agg(F.count("hit").alias("matched"), (F.count("*") - F.count("hit")).alias("skipped"))


_HIST = ["hist_log_flow", "hist_share", "hist_mean_1", "hist_mean_3", "hist_mean_5"]
_HIST_INT = ["hist_rank", "hist_label", *[f"hist_{v}_{k}" for k in (1, 3, 5) for v in ("years", "best")]]


def _span(k: int, what: str) -> str:
    return f"{what} over (partition by type_id, from_city, to_city order by yr range between {k} preceding and 1 preceding)"


@query(f"{_KEYS} " + " ".join([f"{c}:d" for c in _HIST] + [f"{c}:i" for c in _HIST_INT]), f"""select yr, type_id, from_city, to_city, ln(1 + coalesce({_span(1, 'max(n)')}, 0)) as hist_log_flow, coalesce({_span(1, 'max(share)')}, 0)
  as hist_share, coalesce({_span(1, 'max(rnk)')}, 999) as hist_rank, coalesce({_span(1, 'max(label)')}, 0) as hist_label,
{', '.join(f"{_span(k, 'count(*)')} as hist_years_{k}, coalesce({_span(k, 'min(rnk)')}, 999) as hist_best_{k}, coalesce({_span(k, 'avg(label)')}, 0) as hist_mean_{k}" for k in (1, 3, 5))}
from (select yr, type_id, from_city, to_city, rnk, n, case when rnk <= 10 then 1 else 0 end as label, cast(n as double) /
  sum(n) over (partition by yr, type_id, from_city) as share from fx_truth) t""")  # fmt: skip
def history_features(fx):
    return hist.with_history(fx.truth.withColumn("label", lab.hard_label(F.col("rnk"))))


@query("yr:i type_id:s to_city:i score:d", "select yr, type_id, to_city, score from fx_scores")
def last_year_score(fx):
    return hist.last_year_score(fx.base, fx.flows)


@query("yr:i type_id:s pos:i city_name:s score:d", "select yr, type_id, pos, city_name, score from x_ranked join fx_city on to_city = city_id where pos <= 5")
def named_results(fx):
    return ct.with_names(rk.top_k(fx.scores, 5), fx.city)


# Metrics.

_HITS = "select yr, type_id, count(*) as gt, sum(case when pos <= 10 then 1 else 0 end) as h from x_judged group by 1, 2"


@query("yr:i type_id:s cities:s", "select yr, type_id, string_agg(cast(to_city as string), ',' order by to_city) as cities from fx_truth group by 1, 2")
def truth_sets(fx):
    return _joined(fx.truth.groupBy("yr", "type_id").agg(F.sort_array(F.collect_set("to_city")).alias("cities")))


@query("yr:i from_city:i cities:s", "select yr, from_city, string_agg(cast(to_city as string), ',' order by to_city) as cities from x_pairs group by 1, 2")
def candidates_by_origin(fx):
    return _joined(cand.lists_by_origin(pairs(fx)))


@query("yr:i type_id:s size:i best:i", "select yr, type_id, count(*) as size, max(label) as best from x_label group by 1, 2")
def group_sizes(fx):
    labelled = fx.base.withColumn("label", lab.binary(F.col("rnk")))
    return met.group_sizes(labelled).join(labelled.groupBy("yr", "type_id").agg(F.max("label").alias("best")), ["yr", "type_id"])


@query("yr:i pos_weight:d", "select yr, cast(sum(1 - label) as double) / greatest(sum(label), 1) as pos_weight from x_label group by yr")
def class_balance(fx):
    return met.balance_weight(fx.base.withColumn("label", lab.binary(F.col("rnk"))))


@query("yr:i type_id:s gt_size:i hits_10:i recall_10:d precision_10:d", f"""select yr, type_id, gt as gt_size, h as hits_10, cast(h as double) / gt as recall_10, h / 10.0 as precision_10
  from ({_HITS}) g""")
def hits_and_recall(fx):
    return met.judged(ranks(fx), fx.truth, (10,))


@query("yr:i type_id:s recall_10:d", f"select yr, type_id, cast(h as double) / least(10, gt) as recall_10 from ({_HITS}) g")
def recall_least(fx):
    return met.judged(ranks(fx), fx.truth, (10,), "least")


@query("yr:i hits:d hits_best:d", """select yr, avg(h) as hits, avg(b) as hits_best from (select yr, type_id, sum(case when pos <= 10 then 1 else 0 end)
  as h, sum(case when pos <= 10 and rnk <= 5 then 1 else 0 end) as b from x_judged
  group by 1, 2) g group by yr""")
def mean_hits(fx):
    full, best = met.judged(ranks(fx), fx.truth, (10,)), met.judged(ranks(fx), fx.truth, (10,), best=5)
    both = full.join(best.select("yr", "type_id", F.col("hits_10").alias("b")), ["yr", "type_id"])
    return both.groupBy("yr").agg(F.avg("hits_10").alias("hits"), F.avg("b").alias("hits_best"))


_DCG = "sum(case when {0} <= 10 then gain / log2({0} + 1) else 0 end)"
_RANKING = f"""select yr, type_id, count(*) as gt_size, sum(case when pos <= 10 then 1 else 0 end) as hits_10, sum(case when pos <= 10 then cast(so_far
  as double) / pos else 0 end) / least(10, count(*)) as ap_10,
case when min(pos) <= 10 then 1.0 / min(pos) else 0 end as mrr, {_DCG.format('pos')} / {_DCG.format('ideal')} as ndcg_10
  from x_judged group by 1, 2"""


@query("yr:i type_id:s gt_size:i hits_10:i ap_10:d mrr:d ndcg_10:d", _RANKING)
def ranking_metrics(fx):
    return met.judged(ranks(fx), fx.truth, (10,))


@query("yr:i n_queries:i ap_10:d mrr:d ndcg_10:d", f"""select yr, count(*) as n_queries, avg(ap_10) as ap_10, avg(mrr) as mrr, avg(ndcg_10) as ndcg_10
  from ({_RANKING}) r group by rollup (yr)""")
def ranking_metrics_by_year(fx):
    return met.by_year(met.judged(ranks(fx), fx.truth, (10,)), "ap_10", "mrr", "ndcg_10")


@query("n_years:i ndcg_10:d", f"select count(*) as n_years, avg(ndcg_10) as ndcg_10 from (select yr, avg(ndcg_10) as ndcg_10 from ({_RANKING}) r group by yr) y")
def mean_of_years(fx):
    return met.unweighted(met.by_year(met.judged(ranks(fx), fx.truth, (10,)), "ndcg_10"), "ndcg_10")


@query("yr:i percent:d", "select yr, avg(h) / 10.0 * 100 as percent from (" + _HITS + ") g group by yr")
def percent_hits(fx):
    return met.percent_hits(met.judged(ranks(fx), fx.truth, (10,)), 10)


_TWO = """select 'flow' as model, yr, type_id, to_city, score from fx_scores union all select 'near', s.yr, s.type_id, s.to_city, -coalesce(e.w_geo, 1000)
  from fx_scores s left join fx_edges e on e.source_id = s.from_city and e.target_id = s.to_city"""


@query("model:s yr:i n_queries:i hits:d", f"""select model, yr, count(*) as n_queries, avg(h) as hits from (select p.model, t.yr, t.type_id, sum(case when p.pos <= 10 then 1 else 0 end)
  as h from fx_truth t join (select *, row_number() over (partition by model, yr, type_id order by score desc, to_city)
  as pos from ({_TWO}) u) p on p.yr = t.yr and p.type_id = t.type_id and p.to_city = t.to_city
  group by 1, 2, 3) g group by 1, 2""")
def two_models(fx):
    near = pr.with_edges(fx.scores, fx.edges, 1000.0).withColumn("score", -F.col("geo_distance"))
    out = [met.judged(rk.ranked(df), fx.truth, (10,)).withColumn("model", F.lit(m)) for m, df in (("flow", fx.scores), ("near", near))]
    return out[0].unionByName(out[1]).groupBy("model", "yr").agg(F.count("*").alias("n_queries"), F.avg("hits_10").alias("hits"))


@query("yr:i n:i", "select yr, count(distinct type_id) as n from fx_base group by yr")
def distinct_queries(fx):
    return fx.base.groupBy("yr").agg(F.countDistinct("type_id").alias("n"))


@query("type_id:s", "select distinct type_id from fx_base")
def distinct_types(fx):
    return fx.base.select("type_id").distinct()


@query("yr:i queries:i rows:i share:d", "select yr, count(*) as queries, count(*) * 220 as rows, 220.0 / 336 as share from fx_wide group by yr")
def expansion_estimate(fx):
    return met.expansion(fx.wide, 200, 336)


# Ranking.


@query("yr:i type_id:s to_city:i pos:i score:d", "select yr, type_id, to_city, pos, score from x_ranked where pos <= 10")
def top_k(fx):
    return rk.top_k(fx.scores, 10)


@query("yr:i type_id:s to_city:i pos:i", "select yr, type_id, to_city, pos from x_ranked")
def full_order(fx):
    return rk.ranked(fx.scores)


_CASCADE = """select c.*, row_number() over (partition by yr, type_id order by score2 desc, to_city) as rank_pos
  from (select r.yr, r.type_id, r.from_city, r.to_city, r.rnk, r.pos as recall_pos, r.score + coalesce(e.w_geo, 0) / 100
  as score2 from x_ranked r left join fx_edges e on e.source_id = r.from_city and e.target_id = r.to_city
  where pos <= 15) c"""


def _cascaded(fx: Fixtures) -> DataFrame:
    rescored = pr.with_edges(fx.scores, fx.edges).withColumn("score2", F.col("score") + F.col("geo_distance") / 100)
    return rk.cascade(rescored, 15, (5, 10))


@query("yr:i type_id:s to_city:i recall_pos:i rank_pos:i", f"select yr, type_id, to_city, recall_pos, rank_pos from ({_CASCADE}) k where rank_pos <= 10")
def cascade(fx):
    return _cascaded(fx)


@query("yr:i recall_5:d recall_10:d rank_5:d rank_10:d", f"""select yr, avg(a) as recall_5, avg(b) as recall_10, avg(c) as rank_5, avg(d) as rank_10
  from (select yr, type_id, sum(case when rnk > 0 and recall_pos <= 5 then 1 else 0 end) as a, sum(case when rnk > 0
  and recall_pos <= 10 then 1 else 0 end) as b, sum(case when rnk > 0 and rank_pos <= 5 then 1 else 0 end) as c,
  sum(case when rnk > 0 and rank_pos <= 10 then 1 else 0 end) as d from ({_CASCADE}) k
  group by 1, 2) g group by yr""")
def cascade_report(fx):
    rescored = pr.with_edges(fx.scores, fx.edges).withColumn("score2", F.col("score") + F.col("geo_distance") / 100)
    both = rk.cascade(rescored, 15, (15,))
    hit = lambda p, k: F.sum(((F.col("rnk") > 0) & (F.col(p) <= k)).cast("int"))
    names = (("recall_5", "recall_pos", 5), ("recall_10", "recall_pos", 10), ("rank_5", "rank_pos", 5), ("rank_10", "rank_pos", 10))
    per = both.groupBy("yr", "type_id").agg(*[hit(p, k).alias(n) for n, p, k in names])
    return per.groupBy("yr").agg(*[F.avg(n).alias(n) for n, _, _ in names])


@query("yr:i type_id:s to_city:i best_pos:i", """select yr, type_id, to_city, row_number() over (partition by yr, type_id order by case when rnk > 0 then 0 else 1 end, pos)
  as best_pos from x_ranked where pos <= 10""")
def truth_first_bound(fx):
    return rk.truth_first(ranks(fx), 10)


@query("yr:i type_id:s qid:i", "select yr, type_id, row_number() over (order by yr, type_id) - 1 as qid from (select distinct yr, type_id from fx_base) q")
def query_numbers(fx):
    return rk.dense_query_numbers(fx.base.select("yr", "type_id").distinct())


@query("yr:i type_id:s pos:i precision_at:d", """select yr, type_id, pos, cast(sum(case when rnk > 0 then 1 else 0 end) over (partition by yr, type_id order by pos rows unbounded preceding)
  as double) / pos as precision_at from x_ranked""")
def running_precision(fx):
    return rk.running_precision(ranks(fx))


# Sets.


@query(_KEYS, "select yr, type_id, from_city, to_city from x_ranked where pos <= 5 union select yr, type_id, from_city, to_city from fx_truth where rnk <= 5")
def hard_pool(fx):
    return cand.hard_pool(rk.top_k(fx.scores, 5), fx.truth.where("rnk <= 5"))


@query("city_id:i", "select from_city as city_id from fx_flows union select to_city from fx_flows")
def either_end(fx):
    return cand.known_cities(fx.flows)


@query("yr:i type_id:s", "select yr, type_id from fx_truth intersect select yr, type_id from fx_scores")
def common_queries(fx):
    return fx.truth.select("yr", "type_id").intersect(fx.scores.select("yr", "type_id"))


@query("yr:i type_id:s n:i", """select yr, type_id, sum(case when pos <= 10 then 1 else 0 end) as n from (select t.*, r.pos
  from fx_truth t left join x_ranked r on r.yr = t.yr and r.type_id = t.type_id and r.to_city = t.to_city
  where t.rnk <= 10) x group by 1, 2""")
def list_overlap(fx):
    lists = rk.as_lists(rk.top_k(fx.scores, 10)).join(rk.as_lists(fx.truth.where("rnk <= 10").withColumn("pos", F.col("rnk"))).withColumnRenamed("cities", "true_cities"), ["yr", "type_id"])
    return lists.withColumn("n", F.size(F.array_intersect("cities", "true_cities")))


@query("yr:i type_id:s cities:s", """select yr, type_id, string_agg(cast(to_city as string), ',' order by case when rnk > 0 then 0 else 1 end, pos) as cities
  from x_ranked where pos <= 12 group by 1, 2""")
def hits_then_misses(fx):
    truth = fx.truth.groupBy("yr", "type_id").agg(F.collect_set("to_city").alias("t"))
    lists = rk.as_lists(rk.top_k(fx.scores, 12)).join(truth, ["yr", "type_id"], "left").withColumn("t", F.coalesce("t", F.array().cast("array<int>")))
    return _joined(lists.withColumn("cities", rk.hits_then_misses(F.col("cities"), F.col("t"))))


@query("yr:i n:i", "select yr, 2 * count(*) as n from fx_truth group by yr")
def concatenated(fx):
    return src.rows_per_year(fx.truth.unionByName(fx.truth)).withColumnRenamed("n_rows", "n")


# Composite pipelines.

_LABELLED = f"{_KEYS} label:i weight:d {_FEATURES}"
_ROW = "b.yr, b.type_id, b.from_city, b.to_city, b.label, b.weight"


@query(_LABELLED, _feature_sql("""select k.yr, k.type_id, k.from_city, k.to_city, k.label, case when rnk between 1 and 5 then 40 when rnk between 6
  and 20 then 30 else 1 end as weight from x_kept k join x_positive q on q.yr = k.yr and q.type_id = k.type_id
  where q.k <= floor(q.n * 0.6)""", _ROW))
def recall_training_set(fx):
    return pipelines.recall_training(fx.base, pairs(fx), WAGES, VACANCIES, HARD)


@query(_LABELLED, _feature_sql("""select k.yr, k.type_id, k.from_city, k.to_city, case when rnk between 1 and 10 then 12 - rnk when rnk between 11
  and 20 then 1 else 0 end as label, 1 as weight from x_kept k join x_positive q on q.yr = k.yr and q.type_id = k.type_id
  where q.k <= floor(q.n * 0.6)""", _ROW))
def ranking_training_set(fx):
    return pipelines.ranking_training(fx.base, pairs(fx), WAGES, VACANCIES, HARD)


@query(_LABELLED, _feature_sql(f"""select yr, type_id, from_city, to_city, case when rnk > 0 then 1 else 0 end as label, case when rnk between 1 and 3 then 50
  when rnk between 4 and 10 then 35 when rnk between 11 and 20 then 24 else 1 end as weight
  from (select *, row_number() over (partition by yr, type_id, st order by {_MD5}) as k
  from (select b.*, case when rnk > 0 then 0 when to_city in (1000, 1206, 1307) then 1 else 2 end as st
  from fx_base b join x_queries q on q.yr = b.yr and q.type_id = b.type_id
  where q.k <= floor(q.n * 0.8)) s) x where st = 0 or k <= 3""", _ROW))
def stratified_training_set(fx):
    return pipelines.stratified_training(fx.base, pairs(fx), WAGES, VACANCIES, HARD)


_SPLIT = f"(select yr, type_id, from_city, row_number() over (partition by yr order by {_QMD5}, type_id) as k from (select distinct yr, type_id, from_city from fx_truth) q)"


@query(f"split:s {_LABELLED}", _feature_sql(f"""select yr, type_id, from_city, to_city, split, case when rnk > 0 then 1 else 0 end as label, case when rnk between 1
  and 5 then 40 when rnk between 6 and 20 then 30 else 1 end as weight from (select *, row_number() over (partition by yr, type_id, rnk > 0
  order by {_MD5}) as j from (select s.yr, s.type_id, s.from_city, c.city_id as to_city, case when s.k <= 30 then 'train' else 'val' end
  as split, coalesce(t.rnk, 0) as rnk from {_SPLIT} s join fx_city c on c.city_id <> s.from_city
  left join fx_truth t on t.yr = s.yr and t.type_id = s.type_id and t.to_city = c.city_id
  where s.k <= 40) x) y where rnk > 0 or j <= 3""", f"b.split, {_ROW}"))
def recall_set_from_facts(fx):
    return pipelines.recall_from_facts(fx.truth, fx.city, pairs(fx), WAGES, VACANCIES, 30, 10, 3)


@query(f"split:s {_LABELLED}", _feature_sql(f"""select p.yr, p.type_id, p.from_city, p.to_city, case when s.k <= 30 then 'train' else 'val' end as split, case when t.rnk is null then 0 else 21 - t.rnk end
  as label, 1 as weight from (select yr, type_id, from_city, to_city from x_ranked
  where pos <= 10 union select yr, type_id, from_city, to_city from fx_truth) p
  join {_SPLIT} s on s.yr = p.yr and s.type_id = p.type_id left join fx_truth t on t.yr = p.yr and t.type_id = p.type_id
  and t.to_city = p.to_city where s.k <= 40""", f"b.split, {_ROW}"))
def ranking_set_from_lists(fx):
    return pipelines.ranking_from_lists(src.candidate_lists(list_lines(fx)), fx.truth, pairs(fx), WAGES, VACANCIES, 30, 10)


@query(f"{_KEYS} label:i {_FEATURES}", _feature_sql("""select b.yr, b.type_id, b.from_city, b.to_city, case when rnk > 0 then 1 else 0 end as label
  from fx_base b join x_queries q on q.yr = b.yr and q.type_id = b.type_id
  where k <= 10""", "b.yr, b.type_id, b.from_city, b.to_city, b.label"))
def evaluation_set(fx):
    return pipelines.evaluation_set(fx.base, pairs(fx), WAGES, VACANCIES, 10)


@query("yr:i type_id:s cities:s", "select yr, type_id, string_agg(cast(to_city as string), ',' order by rnk) as cities from fx_truth group by 1, 2")
def truth_dictionary(fx):
    lists = rk.as_lists(fx.truth.withColumn("pos", F.col("rnk")))
    return _joined(tid.parse(lists).withColumn("type_id", tid.encoded()))


_FROM_FACTS = f"""(select yr, type_id, to_city, split, case when rnk > 0 then 1 else 0 end as label,
  case when rnk between 1 and 5 then 40 when rnk between 6 and 20 then 30 else 1 end as weight from (
  select *, row_number() over (partition by yr, type_id, rnk > 0 order by {_MD5}) as j from (
    select s.yr, s.type_id, s.from_city, c.city_id as to_city, case when s.k <= 30 then 'train' else 'val' end as split, coalesce(t.rnk, 0) as rnk
    from {_SPLIT} s join fx_city c on c.city_id <> s.from_city left join fx_truth t on t.yr = s.yr and t.type_id = s.type_id and t.to_city = c.city_id
    where s.k <= 40) x) y where rnk > 0 or j <= 3)"""


def _split_written(fx: Fixtures) -> str:
    path = fresh(fx, "training")
    src.write_split(pipelines.recall_from_facts(fx.truth, fx.city, pairs(fx), WAGES, VACANCIES, 30, 10, 3), path)
    return path


@query("yr:i type_id:s to_city:i label:i weight:d", f"select yr, type_id, to_city, label, weight from {_FROM_FACTS} f where split = 'train'")
def training_set_written(fx):
    return src.read_split(fx.spark, _split_written(fx), "train")


@query("yr:i type_id:s size:i positives:i", f"select yr, type_id, count(*) as size, sum(label) as positives from {_FROM_FACTS} f where split = 'val' group by 1, 2")
def validation_set_saved(fx):
    """Labels and group sizes of the validation queries, from what was written."""
    held = src.read_split(fx.spark, _split_written(fx), "val")
    return held.groupBy("yr", "type_id").agg(F.count("*").alias("size"), F.sum("label").alias("positives"))


@query(_LABELLED, _feature_sql(f"""select yr, type_id, from_city, to_city, case when rnk > 0 then 1 else 0 end as label,
  case when rnk between 1 and 5 then 40 when rnk between 6 and 20 then 30 else 1 end as weight from (
  select *, row_number() over (partition by yr, type_id, rnk > 0 order by {_MD5}) as k from fx_base) x where rnk > 0 or k <= 10""", _ROW))
def merged_training_set(fx):
    """All years in one set, at most ten negatives a query."""
    return pipelines.merged_training(fx.base, pairs(fx), WAGES, VACANCIES, 10)


@query("yr:i queries:i rows:i most:i", f"""select yr, count(*) as queries, sum(n) as rows, max(n) as most from (select yr, type_id, count(*) as n
  from (select *, row_number() over (partition by yr, type_id, rnk > 0 order by {_MD5}) as k
  from fx_base) x where rnk > 0 or k <= 4 group by 1, 2) g group by yr""")
def merged_training_sizes(fx):
    sizes = met.group_sizes(smp.exact_negatives(fx.base, 4))
    return sizes.groupBy("yr").agg(F.count("*").alias("queries"), F.sum("size").alias("rows"), F.max("size").alias("most"))


@query(f"{_KEYS} hist_log_flow:d hist_share:d tier_diff:i", """select b.yr, b.type_id, b.from_city, b.to_city, ln(1 + coalesce(h.n, 0)) as hist_log_flow, coalesce(h.share, 0)
  as hist_share, coalesce(p.tier_diff, 0) as tier_diff from fx_truth b left
  join (select yr, type_id, to_city, n, cast(n as double) / sum(n) over (partition by yr, type_id) as share
  from fx_truth) h on h.yr = b.yr - 1 and h.type_id = b.type_id and h.to_city = b.to_city
  left join x_pairs p on p.yr = b.yr and p.from_city = b.from_city and p.to_city = b.to_city""")
def transform_evaluate(fx):
    known = hist.with_history(fx.truth.withColumn("label", lab.binary(F.col("rnk"))))
    return pipelines.transform(fx.truth, pairs(fx), known, WAGES, VACANCIES, "eval")


_KEPT = f"cast(concat('0x', substr({_MD5.replace('yr', 'b.yr').replace('type_id', 'b.type_id').replace('to_city', 'b.to_city')}, 1, 8)) as bigint) / 4294967296.0 >= 0.1"


@query(f"{_KEYS} hist_log_flow:d hist_share:d tier_diff:i", f"""select b.yr, b.type_id, b.from_city, b.to_city, case when {_KEPT} then ln(1 + coalesce(h.n, 0)) else 0 end as hist_log_flow,
  case when {_KEPT} then coalesce(h.share, 0) else 0 end as hist_share, coalesce(p.tier_diff, 0) as tier_diff
  from fx_truth b left join (select yr, type_id, to_city, n, cast(n as double) / sum(n) over (partition by yr, type_id) as share from fx_truth) h
  on h.yr = b.yr - 1 and h.type_id = b.type_id and h.to_city = b.to_city left join x_pairs p on p.yr = b.yr and p.from_city = b.from_city and p.to_city = b.to_city""")
def transform_train(fx):
    """In training, history is blanked for a tenth of the rows."""
    known = hist.with_history(fx.truth.withColumn("label", lab.binary(F.col("rnk"))))
    return pipelines.transform(fx.truth, pairs(fx), known, WAGES, VACANCIES, "train", 0.1)


@query("recall_5:d recall_10:d n:i", f"""select avg(cast(h5 as double) / least(5, gt)) as recall_5, avg(cast(h10 as double) / least(10, gt)) as recall_10, count(*)
  as n from (select yr, type_id, count(*) as gt, sum(case when pos <= 5 then 1 else 0 end) as h5, sum(case when pos <= 10 then 1 else 0 end)
  as h10 from x_judged group by 1, 2) g where (yr, type_id) in (select yr, type_id
  from (select distinct yr, type_id from fx_truth) q order by {_QMD5}, yr, type_id limit 200)""")
def offline_recall(fx):
    lists = src.candidate_lists(src.json_lines(rk.as_lists(rk.ranked(fx.scores)), 100), None)
    chosen = smp.sample_common(lists, fx.truth, 200)
    per = met.judged(lists.select("yr", "type_id", F.posexplode("cities").alias("p", "to_city")).withColumn("pos", F.col("p") + 1), fx.truth, (5, 10), "least")
    return per.join(chosen, ["yr", "type_id"], "left_semi").agg(F.avg("recall_5").alias("recall_5"), F.avg("recall_10").alias("recall_10"), F.count("*").alias("n"))


# Batch scoring with a fixed formula.

_SCORE = "round(coalesce(p.population_total_ratio, 0) + 0.5 * coalesce(p.gdp_per_capita_ratio, 0) + coalesce(p.migrant_stock_from_to, 0) - coalesce(p.geo_distance, 0) / 1000, 9)"
_SCORED = f"""select b.yr, b.type_id, b.from_city, b.to_city, {_SCORE} as score from fx_base b
  left join x_pairs p on p.yr = b.yr and p.from_city = b.from_city and p.to_city = b.to_city"""


@query("yr:i type_id:s pos:i to_city:i score:d", f"""select * from (select *, row_number() over (partition by yr, type_id order by score desc, to_city) as pos
  from ({_SCORED}) s) r where pos <= 10""")
def batch_recall(fx):
    queries = fx.base.select("yr", "type_id", "from_city").distinct()
    return pipelines.batch_recall(queries, fx.city, pairs(fx), WAGES, VACANCIES, pipelines.fixed_scorer, 10)


@query("yr:i value:s", f"""select yr, concat('{{\"', type_id, '\":[', string_agg(cast(to_city as string), ',' order by pos), ']}}') as value
  from (select s.*, row_number() over (partition by s.yr, s.type_id order by s.score desc, s.to_city) as pos
  from ({_SCORED}) s join x_ranked r on r.yr = s.yr and r.type_id = s.type_id and r.to_city = s.to_city
  where r.pos <= 10) k where pos <= 6 group by yr, type_id""")
def rescored_lines(fx):
    queries = fx.base.select("yr", "type_id", "from_city").distinct()
    best = pipelines.rescore(queries, src.candidate_lists(list_lines(fx)), pairs(fx), WAGES, VACANCIES, pipelines.fixed_scorer, 6)
    return src.json_lines(rk.as_lists(best), 6)


@query("idx:i pos:i to_city:i city_name:s score:d", f"""select idx, pos, to_city, city_name, score from (
  select q.idx, s.to_city, c.city_name, s.score, row_number() over (partition by q.idx order by s.score desc, s.to_city) as pos
  from (select row_number() over (order by yr, type_id) as idx, yr, type_id from (select distinct yr, type_id from fx_base) d) q
  join ({_SCORED}) s on s.yr = q.yr and s.type_id = q.type_id join fx_city c on c.city_id = s.to_city) r where pos <= 5""")
def predict_batch(fx):
    asked = rk.dense_query_numbers(fx.base.select("yr", "type_id").distinct())
    asked = asked.select("yr", "type_id", (F.col("qid") + 1).alias("idx"), F.lit(None).cast("string").alias("origin"))
    bad = asked.limit(1).select("yr", F.lit("M_20").alias("type_id"), F.lit(0).alias("idx"), "origin")
    return pipelines.predict(asked.unionByName(bad), fx.city, pairs(fx), WAGES, VACANCIES, pipelines.fixed_scorer, 5)


@query("chunk:i n:i best:d", f"""select chunk, count(*) as n, max(score) as best from (
  select cast(floor((dense_rank() over (order by yr, type_id) - 1) / 100) as int) as chunk, score from ({_SCORED}) s) c group by chunk""")
def scored_chunks(fx):
    """Scoring by chunks of a hundred queries, each chunk's rows together in one partition."""
    chunks = rk.dense_query_numbers(fx.base).withColumn("chunk", F.floor(F.col("qid") / 100).cast("int")).repartition("chunk")
    scored = pipelines.fixed_scorer(pipelines.with_features(chunks, pairs(fx), WAGES, VACANCIES))
    return scored.groupBy("chunk").agg(F.count("*").alias("n"), F.max("score").alias("best"))


@query("recall_5:d recall_10:d recall_20:d", f"""select avg(cast(h5 as double) / least(5, gt)) as recall_5, avg(cast(h10 as double) / least(10, gt)) as recall_10,
  avg(cast(h20 as double) / least(20, gt)) as recall_20 from (
  select t.yr, t.type_id, count(*) as gt, sum(case when pos <= 5 then 1 else 0 end) as h5, sum(case when pos <= 10 then 1 else 0 end)
  as h10, sum(case when pos <= 20 then 1 else 0 end) as h20
  from fx_truth t left join (select *, row_number() over (partition by yr, type_id order by score desc, to_city)
  as pos from ({_SCORED}) s) p
  on p.yr = t.yr and p.type_id = t.type_id and p.to_city = t.to_city group by 1, 2) g""")
def validation_metric(fx):
    scored = pipelines.fixed_scorer(pipelines.with_features(fx.base, pairs(fx), WAGES, VACANCIES))
    return learn.validation_recall(scored, fx.truth)


#: An exported model of one split a tree: feature, threshold, value up to it, value above it.
STUMPS = [("geo_distance", 55.0, 0.5, 0.1), ("tier_diff", 0.0, 0.3, 0.7), ("population_total_ratio", 1.0, 0.1, 0.6), ("is_same_province", 0.0, 0.2, 0.4),
          ("migrant_stock_from_to", 0.05, 0.0, 0.8), ("gdp_per_capita_ratio", 1.0, 0.3, 0.45), ("dialect_distance", 2.0, 0.25, 0.05), ("housing_price_avg_ratio", 0.9, 0.35, 0.15)]


def _stumps(n: int | None = None) -> str:
    return " + ".join(f"case when coalesce(p.{f}, 0) <= {t} then {a} else {b} end" for f, t, a, b in STUMPS[:n])


@query("yr:i type_id:s to_city:i score:d prefix:d", f"""select b.yr, b.type_id, b.to_city, {_stumps()} as score, {_stumps(3)} as prefix
  from fx_base b left join x_pairs p on p.yr = b.yr and p.from_city = b.from_city and p.to_city = b.to_city""")
def prefix_scores(fx):
    """All trees, and a quarter of them but three at least."""
    rows = pipelines.with_features(fx.base, pairs(fx), WAGES, VACANCIES)
    first = learn.prefix_length(len(STUMPS), 0.25, 3)
    return learn.score_stumps(learn.score_stumps(rows, STUMPS), STUMPS, first, "prefix")


@query("column_name:s importance:d", f"""select column_name, importance from ({" union all ".join(f"select '{c}' as column_name, avg(abs({c})) as importance from x_pairs" for c in PAIR_COLUMNS)}) v
  order by importance desc, column_name limit 15""")
def importance_report(fx):
    """The fifteen features of the greatest mean size."""
    p = pairs(fx)
    means = p.agg(*[F.avg(F.abs(F.col(c))).alias(c) for c in PAIR_COLUMNS])
    long = means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in PAIR_COLUMNS])).alias("v")).select("v.*")
    return learn.top_features(long, 15).withColumnRenamed("feature", "column_name")


_REL = "case when rnk between 1 and 20 then 21 - rnk else 0 end"
_GAIN = "[0, 1, 3, 5, 7, 10, 14, 19, 25, 32, 40, 50][cast(ceil(" + _REL + " * 11 / 20.0) as int) + 1]"
_AT = "1 / log2(1 + case when rnk > 0 then rnk else 21 end)"


@query("yr:i pairs:i weight:d spread:d", f"""with r as (select b.yr, b.type_id, {_REL} as rel, {_GAIN} as gain, {_AT} as at_, coalesce(p.tier_diff, 0) as tier_diff
  from fx_base b left join x_pairs p on p.yr = b.yr and p.from_city = b.from_city and p.to_city = b.to_city)
select a.yr, count(*) as pairs, avg(abs((a.gain - b.gain) * (a.at_ - b.at_))) as weight, sum(a.tier_diff - b.tier_diff) as spread
from r a join r b on b.yr = a.yr and b.type_id = a.type_id and a.rel > b.rel where a.rel > 0 group by a.yr""")
def preference_pairs(fx):
    found = learn.preference_pairs(pipelines.with_features(fx.base, pairs(fx), WAGES, VACANCIES), ["tier_diff"])
    return found.groupBy("yr").agg(F.count("*").alias("pairs"), F.avg("weight").alias("weight"), F.sum("tier_diff").alias("spread"))
