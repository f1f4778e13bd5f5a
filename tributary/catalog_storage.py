"""Registered queries over what is written and read again: ledgers, buckets, codes, files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.catalog import _EARLIER, CODES, PAIR_COLUMNS, _codes, _PART, fresh, pairs, query
from tributary.functions import categories, features
from tributary.functions.typeid import parse_lenient
from tributary.operators import pairs as pr
from tributary.plans.fixtures import Fixtures
from tributary.sources import files, ledger
from tributary.sources import tables as src

# What is already written.


def _broken_off(fx: Fixtures) -> str:
    """An export that stopped after three years, with a fourth begun and not committed."""
    folder = fresh(fx, "ledger")
    written = ledger.write_missing_years(fx.base, folder, "type_id", "to_city", most=3)
    later = fx.base.where(F.col("yr") == max(written) + 1)
    later.drop("yr").where("rnk > 0").write.parquet(f"{folder}/data/yr={max(written) + 1}")
    return folder


@query("yr:i", "select yr from (select yr, row_number() over (order by yr) as k from (select distinct yr from fx_base) y) z where k > 3")
def years_to_do(fx):
    """What a broken-off export still has to write: the years its ledger doesn't have."""
    return ledger.years_to_write(fx.base, _broken_off(fx))


@query("yr:i n_rows:i digest:i kept:i lines:i", """select yr, count(*) as n_rows, sum(cast(concat('0x', substr(md5(concat_ws(':', type_id, cast(to_city as string))), 1, 8)) as bigint)) as digest,
  count(*) as kept, 1 as lines from fx_base group by yr""")  # fmt: skip
def export_resumed(fx):
    """A broken-off export begun again: each year committed once, the half-written one whole."""
    folder = _broken_off(fx)
    ledger.write_missing_years(fx.base, folder, "type_id", "to_city")
    kept = ledger.read_years(fx.spark, folder).groupBy("yr").agg(F.count("*").alias("kept"))
    lines = ledger.committed(fx.spark, folder).groupBy(F.col("what").cast("int").alias("yr")).agg(F.max("n_rows").alias("n_rows"), F.max("digest").alias("digest"), F.count("*").alias("lines"))
    return lines.join(kept, "yr", "left")


# The pair lookup without a shuffle.


def bucketed_join(base: DataFrame, features_: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Base rows with their pair features from two tables written for it; an unknown pair has zeros."""
    name = folder.rsplit("/", 1)[-1].replace("-", "_")
    left = pr.write_bucketed(base, f"{name}_base", f"{folder}/base", buckets)
    right = pr.write_bucketed(features_, f"{name}_pairs", f"{folder}/pairs", buckets)
    return pr.join_pairs(left, right.hint("merge"))


@query("yr:i type_id:s from_city:i to_city:i rnk:i " + " ".join(f"{c}:d" for c in PAIR_COLUMNS), f"""select b.yr, b.type_id, b.from_city, b.to_city, b.rnk, {', '.join(f'coalesce(p.{c}, 0) as {c}' for c in PAIR_COLUMNS)}
  from fx_base b left join x_pairs p on p.yr = b.yr and p.from_city = b.from_city and p.to_city = b.to_city""")  # fmt: skip
def bucketed_lookup(fx):
    """All base rows with all pair features; written dealt by the pair, joined without an exchange."""
    return bucketed_join(fx.base, pairs(fx), fresh(fx, "buckets"), 8)


# Category codes.

_CATEGORIES = [*CODES, "from_city", "to_city", "is_same_province"]
_CODED = f"(select b.yr, b.from_city, b.to_city, {_codes(_PART)}, case when floor(b.from_city / 100) = floor(b.to_city / 100) then 1 else 0 end as is_same_province, type_id from fx_base b)"


@query("yr:i type_id:s to_city:i " + " ".join(f"{c}_code:i" for c in _CATEGORIES), f"""with rows_ as materialized {_CODED},
codes_ as materialized ({' union all '.join(f"select '{c}' as column_name, v, row_number() over (order by v) - 1 as code from (select distinct cast({c} as string) as v from rows_ where yr < 1999 and to_city < 1400) d" for c in _CATEGORIES)})
select yr, type_id, r.to_city, {', '.join(f"coalesce((select code from codes_ k where k.column_name = '{c}' and k.v = cast(r.{c} as string)), -1) as {c}_code" for c in _CATEGORIES)} from rows_ r where yr >= 1999""")  # fmt: skip
def category_codes(fx):
    """Codes of nine columns, fitted on rows before 1999 to cities below 1400, stored, read back and given to
    later rows; the cities they haven't seen have a code of their own."""
    rows = parse_lenient(fx.base).withColumnRenamed("type_id_orig", "type_id")
    rows = rows.withColumn("is_same_province", (F.floor(F.col("from_city") / 100) == F.floor(F.col("to_city") / 100)).cast("int"))
    folder = categories.save_codes(categories.fit_codes(rows.where("yr < 1999 and to_city < 1400"), _CATEGORIES), fresh(fx, "model"))
    return categories.with_codes(rows.where("yr >= 1999"), categories.load_codes(fx.spark, folder), _CATEGORIES)


# The older chunk-wise transform.


@query("yr:i type_id:s to_city:i geo_distance:d is_same_province:i " + " ".join(f"{c}:i" for c in CODES) + " " + " ".join(f"{c}_ratio:d" for c in _EARLIER), f"""select b.yr, b.type_id, b.to_city, coalesce(e.w_geo, -1) as geo_distance,
  case when floor(b.from_city / 100) = floor(b.to_city / 100) then 1 else 0 end as is_same_province, {', '.join(CODES)},
  {', '.join(f'cast(least(greatest(case when f.{c} > 1e-5 then coalesce(t.{c}, 0) / (f.{c} + 1e-5) else 1 end, 0.1), 10) as float) as {c}_ratio' for c in _EARLIER)}
  from (select *, {_codes(_PART)} from fx_base) b left join fx_city_attr f on f.yr = b.yr and f.city_id = b.from_city left join fx_city_attr t on t.yr = b.yr and t.city_id = b.to_city
  left join fx_edges e on e.source_id = b.from_city and e.target_id = b.to_city""")  # fmt: skip
def chunk_transform(fx):
    """Types parsed, earlier pair features joined, every column in the least width that holds it: all rows, one plan."""
    kept = ["yr", "from_city", "to_city", "geo_distance", "is_same_province", *[f"{c}_ratio" for c in _EARLIER]]
    known = pr.pair_features_earlier(fx.base.select("yr", "from_city", "to_city").distinct(), fx.city_attr, fx.edges, _EARLIER).select(*kept)
    rows = parse_lenient(fx.base).withColumnRenamed("type_id_orig", "type_id").join(known, ["yr", "from_city", "to_city"])
    return features.downcast(rows)


# Files.

_NAME = "cities_{yr}.jsonl"


def _city_files(fx: Fixtures) -> str:
    """City lines of the older flavour in files by year: 1997 is missing, each year has a blank line and one
    that breaks off."""
    folder = fresh(fx, "files")
    s = fx.sector.groupBy("yr", "city_id").agg(F.map_from_entries(F.collect_list(F.struct(F.get(F.array(*map(F.lit, src.SECTORS)), F.col("ind")).alias("k"), F.struct("share", F.col("wage").alias("avg_wage"))))).alias("sectors"))
    c = fx.city_attr.join(s, ["yr", "city_id"], "left").join(fx.city.select("city_id", "city_name"), "city_id")
    at = lambda k: (F.col("city_id") % 100 + k).cast("double")
    value = F.struct(F.col("city_id").cast("string").alias("city_id"), "city_name", F.struct("tier", at(0.5).alias("area_sqkm")).alias("basic_info"),
        F.struct("gdp_per_capita", at(100).alias("cpi_index"), (at(3) / 100).alias("unemployment_rate"), F.col("sectors").alias("industry_sectors")).alias("economy"),
        F.struct("housing_price_avg", at(1000).alias("rent_avg"), at(7).alias("daily_cost_index")).alias("living_cost"),
        F.struct(at(1).alias("medical_score"), at(2).alias("education_score"), at(3).alias("transport_convenience"), at(20).alias("avg_commute_mins")).alias("public_services"),
        F.struct("population_total").alias("social_context"))
    lines = c.select("yr", F.to_json(value).alias("value")).where("yr <> 1997")
    bad = lines.groupBy("yr").agg(F.min("value").alias("value")).select("yr", F.explode(F.array(F.lit("  "), F.substring("value", 1, 40))).alias("value"))
    for r in lines.select("yr").distinct().collect():  # a file a year
        lines.unionByName(bad).where(F.col("yr") == r["yr"]).select("value").write.text(f"{folder}/cities_{r['yr']}.jsonl")
    return folder


_OLD = "yr:i city_id:i city_name:s tier:i area_sqkm:d gdp_per_capita:d cpi_index:d unemployment_rate:d " + " ".join(f"{s}_{k}:d" for s in src.SECTORS for k in ("share", "wage")) + " housing_price_avg:d rent_avg:d daily_cost_index:d medical_score:d education_score:d transport_convenience:d avg_commute_mins:d population_total:d"


@query(_OLD, f"""select a.yr, a.city_id, c.city_name, a.tier, a.city_id % 100 + 0.5 as area_sqkm, a.gdp_per_capita, a.city_id % 100 + 100 as cpi_index, (a.city_id % 100 + 3) / 100.0 as unemployment_rate,
  {', '.join(f'coalesce(max(case when s.ind = {k} then s.{v} end), 0) as {n}_{o}' for k, n in enumerate(src.SECTORS) for o, v in (('share', 'share'), ('wage', 'wage')))},
  a.housing_price_avg, a.city_id % 100 + 1000 as rent_avg, a.city_id % 100 + 7 as daily_cost_index, a.city_id % 100 + 1 as medical_score, a.city_id % 100 + 2 as education_score, a.city_id % 100 + 3 as transport_convenience,
  a.city_id % 100 + 20 as avg_commute_mins, a.population_total from fx_city_attr a join fx_city c on c.city_id = a.city_id left join fx_sector s on s.yr = a.yr and s.city_id = a.city_id
  where a.yr <> 1997 group by all""")  # fmt: skip
def nested_city_files(fx):
    """All columns of the older flavour from files, the year of each line by the name of its file."""
    read = files.read_lines(fx.spark, _city_files(fx), _NAME, src.CITY_SCHEMA)
    return src.city_attributes_earlier(read.where("broken is null").select("yr", F.to_json("c").alias("value")))


@query("yr:i good:i broken:i", "select yr, count(*) as good, 1 as broken from fx_city_attr where yr <> 1997 group by yr")
def broken_lines(fx):
    """A line that breaks off is kept as it is, beside the lines that are read."""
    read = files.read_lines(fx.spark, _city_files(fx), _NAME, src.CITY_SCHEMA)
    return read.groupBy("yr").agg(F.count("c").alias("good"), F.count("broken").alias("broken"))


@query("yr:i files:i", "select distinct yr, 0 as files from fx_city_attr where yr = 1997")
def missing_files(fx):
    """Years asked for of which a listing of the folder has no file."""
    there = files.years_there(fx.spark, _city_files(fx), _NAME)
    return files.years_missing(fx.city_attr, there).withColumn("files", F.lit(0))


@query("source_id:i target_id:i w_geo:d w_dialect:d", "select distinct source_id, target_id, w_geo, w_dialect from fx_edges")
def edge_files(fx):
    """Edges from JSON lines, ids as texts there; blank and broken lines are passed over."""
    folder = fresh(fx, "files")
    lines = fx.edges.select(F.to_json(F.struct(F.col("source_id").cast("string").alias("source_id"), F.col("target_id").cast("string").alias("target_id"), "w_geo", "w_dialect")).alias("value"))
    bad = lines.limit(1).select(F.explode(F.array(F.lit(""), F.lit('{"source_id": "1'))).alias("value"))
    lines.unionByName(bad).write.text(f"{folder}/edges_2000.jsonl")
    read = files.read_lines(fx.spark, folder, "edges_{yr}.jsonl", "source_id string, target_id string, w_geo double, w_dialect double")
    return src.edges(read.where("broken is null").select("c.*"))
