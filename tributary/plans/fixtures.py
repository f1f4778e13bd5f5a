"""Flows, cities and truth derived from the star-schema tables, in SQL that both engines read."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WIDE = ",\n".join(f"max(case when rnk = {k} then concat(city_name, '(', cast(to_city as string), ')') end) as To_Top{k}, max(case when rnk = {k} then n end) as To_Top{k}_Count" for k in range(1, 21))

#: Averages are moved off the middle between two roundings, which engines take differently.
FIXTURES = {
    "fx_city": "select n_nationkey as nk, cast(1000 + n_regionkey*100 + n_nationkey as int) as city_id, n_name as city_name, n_regionkey as tier from nation",
    "fx_flows": """select cast(year(o_orderdate) as int) as yr,
       concat_ws('_', case when c_nationkey % 2 = 0 then 'M' else 'F' end,
         case c_mktsegment when 'AUTOMOBILE' then '20' when 'BUILDING' then '30' when 'FURNITURE' then '40' when 'HOUSEHOLD' then '55' else '65' end,
         case c_nationkey % 3 when 0 then 'EduLo' when 1 then 'EduMid' else 'EduHi' end,
         case (c_nationkey + length(c_mktsegment)) % 4 when 0 then 'Agri' when 1 then 'Mfg' when 2 then 'Service' else 'Wht' end,
         case c_nationkey % 5 when 0 then 'IncL' when 1 then 'IncML' when 2 then 'IncM' when 3 then 'IncMH' else 'IncH' end,
         case when c_nationkey % 7 < 3 then 'Split' else 'Unit' end,
         cast(f.city_id as string)) as type_id,
       f.city_id as from_city, t.city_id as to_city, count(*) as n
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
join fx_city f on f.nk = c_nationkey join fx_city t on t.nk = s_nationkey group by 1, 2, 3, 4""",
    "fx_truth": """select yr, type_id, from_city, to_city, n, rnk from (
  select yr, type_id, from_city, to_city, n, cast(row_number() over (partition by yr, type_id order by n desc, to_city) as int) as rnk
  from fx_flows where from_city <> to_city) x where rnk <= 20""",
    "fx_wide": f"select yr, type_id, {_WIDE} from fx_truth join fx_city on to_city = city_id group by yr, type_id",
    "fx_base": """select q.yr, q.type_id, q.from_city, c.city_id as to_city, coalesce(t.rnk, 0) as rnk
from (select distinct yr, type_id, from_city from fx_flows) q join fx_city c on c.city_id <> q.from_city
left join fx_truth t on t.yr = q.yr and t.type_id = q.type_id and t.to_city = c.city_id""",
    "fx_city_attr": """select yr, city_id, tier, cast(count(distinct c_custkey) as double) as population_total,
       round(avg(o_totalprice) + 1e-8, 6) as gdp_per_capita, round(avg(c_acctbal) + 1e-8, 6) as housing_price_avg
from (select cast(year(o_orderdate) as int) as yr, o_custkey, o_totalprice from orders) o
join customer on o_custkey = c_custkey join fx_city on nk = c_nationkey group by yr, city_id, tier""",
    "fx_sector": """select yr, city_id, ind, cast(cnt as double) / sum(cnt) over (partition by yr, city_id) as share, wage, vacancy
from (select cast(year(o_orderdate) as int) as yr, city_id, p_size % 4 as ind, count(*) as cnt,
             round(avg(l_extendedprice) + 1e-8, 6) as wage, round(avg(l_discount) + 1e-8, 6) as vacancy
      from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
      join supplier on l_suppkey = s_suppkey join fx_city on nk = s_nationkey group by 1, 2, 3) g""",
    "fx_city_more": """select m.yr, m.city_id, area_sqkm, cpi_index, unemployment_rate, rent_avg, daily_cost_index, medical_score, education_score, transport_convenience, avg_commute_mins,
       age_0_17, age_18_34, age_35_54, age_55_64, age_65_plus, sex_ratio
from (select cast(year(o_orderdate) as int) as yr, city_id, round(avg(l_extendedprice / l_quantity) / 10 + 1e-8, 6) as cpi_index,
             round(avg(cast(case when l_returnflag = 'R' then 1 else 0 end as double)) + 1e-8, 6) as unemployment_rate,
             round(avg(l_extendedprice * (1 - l_discount)) / 10 + 1e-8, 6) as rent_avg, round(avg(l_extendedprice * (1 + l_tax)) / 100 + 1e-8, 6) as daily_cost_index,
             round(avg(l_quantity) + 1e-8, 6) as medical_score, round(100 * avg(l_tax) + 1e-8, 6) as education_score,
             round(avg(cast(case when l_linestatus = 'F' then 1 else 0 end as double)) + 1e-8, 6) as transport_convenience,
             round(avg(cast(day(l_shipdate) as double)) + 1e-8, 6) as avg_commute_mins
      from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join fx_city on nk = c_nationkey group by 1, 2) m
join (select cast(year(o_orderdate) as int) as yr, city_id, round(avg(cast(case when o_orderpriority = '1-URGENT' then 1 else 0 end as double)) + 1e-8, 6) as age_0_17,
             round(avg(cast(case when o_orderpriority = '2-HIGH' then 1 else 0 end as double)) + 1e-8, 6) as age_18_34,
             round(avg(cast(case when o_orderpriority = '3-MEDIUM' then 1 else 0 end as double)) + 1e-8, 6) as age_35_54,
             round(avg(cast(case when o_orderpriority = '4-NOT SPECIFIED' then 1 else 0 end as double)) + 1e-8, 6) as age_55_64,
             round(avg(cast(case when o_orderpriority = '5-LOW' then 1 else 0 end as double)) + 1e-8, 6) as age_65_plus,
             round(90 + 20 * avg(cast(o_custkey % 2 as double)) + 1e-8, 6) as sex_ratio
      from orders join customer on o_custkey = c_custkey join fx_city on nk = c_nationkey group by 1, 2) p on p.yr = m.yr and p.city_id = m.city_id
join (select city_id, cast(count(*) as double) as area_sqkm from customer join fx_city on nk = c_nationkey group by 1) a on a.city_id = m.city_id""",
    "fx_edges": """select f.city_id as source_id, t.city_id as target_id,
       cast(abs(f.nk - t.nk) * 10.5 as double) as w_geo, cast(abs(f.tier - t.tier) * 1.25 as double) as w_dialect
from fx_city f join fx_city t on f.city_id <> t.city_id where (f.nk + t.nk) % 7 <> 0""",
    "fx_migrant": """select yr, to_city, province, cast(n as double) / sum(n) over (partition by yr, to_city) as share
from (select yr, to_city, cast(cast(floor(from_city / 100) as int) * 100 as string) as province, sum(n) as n from fx_flows group by 1, 2, 3) g""",
    "fx_scores": """select b.yr, b.type_id, b.from_city, b.to_city, b.rnk, cast(coalesce(h.n, 0) as double) as score
from fx_base b left join fx_flows h on h.yr = b.yr - 1 and h.type_id = b.type_id and h.to_city = b.to_city""",
}
TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem")

#: The fixtures as common table expressions, for SQL that follows.
WITH = "with " + ",\n".join(f"{name} as ({sql})" for name, sql in FIXTURES.items())


def _over_lines(name: str, rows: str, *changes: tuple[str, str]) -> str:
    """A fixture's own SQL over `rows` of lines instead of the joined tables; changes: what those name otherwise."""
    sql = re.sub(r"lineitem join .*?(?= group by )", rows, FIXTURES[name], count=1, flags=re.DOTALL)
    for old, new in (("cast(year(o_orderdate) as int) as yr", "yr"), *changes):
        sql = sql.replace(old, new, 1)
    return sql


#: Flows are counted by their numbers first, so that a type id is put together once a flow, not once a line.
_PAIRS = """(select yr, c_nationkey, c_mktsegment, from_id, to_id, count(*) as k from fx_lines
  where c_copy is not null and s_copy is not null group by 1, 2, 3, 4, 5) x"""
_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
#: What both fixtures that take every order ask of a city: orders meet their customers once. Shares are left as counts, as
#: only one of the two has the tier among its keys, and a priority is dealt as its number.
_BY_ORDERS = f"""select yr, city_id, tier, cast(count(distinct c_custkey) as double) as population_total,
       round(avg(o_totalprice) + 1e-8, 6) as gdp_per_capita, round(avg(c_acctbal) + 1e-8, 6) as housing_price_avg,
       count(*) as k, sum(o_custkey % 2) as odd, {", ".join(f"count_if(priority = {i}) as priority_{i}" for i in range(1, 6))}
from (select cast(year(o_orderdate) as int) as yr, o_custkey, o_totalprice, array_position(array{_PRIORITIES}, o_orderpriority) as priority from orders) o
join customer on o_custkey = c_custkey join fx_city on nk = c_nationkey group by yr, city_id, tier"""
_SHARES = ", ".join(f"round(sum(priority_{i}) / sum(k) + 1e-8, 6) as age_{a}" for i, a in enumerate(("0_17", "18_34", "35_54", "55_64", "65_plus"), 1))
_FROM_ORDERS = f"join (select yr, city_id, {_SHARES}, round(90 + 20 * (sum(odd) / sum(k)) + 1e-8, 6) as sex_ratio from fx_by_orders group by 1, 2) p"

#: What Spark runs for the fixtures that take every line or order: the joins are made once, for all of them (`fx_lines`, `fx_by_orders`).
OVER_LINES = {
    "fx_by_orders": _BY_ORDERS,
    "fx_city_attr": "select yr, city_id, tier, population_total, gdp_per_capita, housing_price_avg from fx_by_orders",
    "fx_flows": _over_lines("fx_flows", _PAIRS, ("f.city_id", "from_id"), ("f.city_id", "from_id"), ("t.city_id", "to_id"), ("count(*)", "sum(k)")),
    "fx_sector": _over_lines("fx_sector", "(select * from fx_lines where s_copy is not null and coalesce(c_copy, 1) = 1) x join part on l_partkey = p_partkey", ("yr, city_id, p_size", "yr, to_id as city_id, p_size")),
    "fx_city_more": _over_lines("fx_city_more", "fx_lines where c_copy is not null and coalesce(s_copy, 1) = 1", ("yr, city_id, round(", "yr, from_id as city_id, round("),
                                ("l_returnflag = 'R'", "returned"), ("l_linestatus = 'F'", "finished"), ("day(l_shipdate)", "ship_day")),
}
OVER_LINES["fx_city_more"] = re.sub(r"join \(select cast\(year.*?\) p(?= on )", _FROM_ORDERS, OVER_LINES["fx_city_more"], count=1, flags=re.DOTALL)

#: So many suppliers at most, two numbers each, are sent to every executor whole; more are joined by shuffle.
SUPPLIERS_SENT = 1_000_000

#: Fixtures that several queries start from: written once for a session and folder, then read.
STAGED = ("fx_lines", "fx_by_orders", "fx_flows", "fx_truth", "fx_city_attr", "fx_city_more", "fx_sector", "fx_migrant", "fx_scores")
_staged: dict[tuple, str] = {}


@cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="tributary-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on one machine a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_folder(spark.sparkContext.applicationId)


def _file(spark: SparkSession, path: str):
    """A path and the file system that has it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def forget_at_exit(spark: SparkSession, path: str) -> str:
    """The folder goes when the application ends, on whatever store it is."""
    at, store = _file(spark, path)
    store.mkdirs(at)  # only what is there can be marked
    store.deleteOnExit(at)
    return path


class Fixtures:
    """The fixtures over one folder of tables, each made when it is first asked for.

    Those in STAGED are kept for the session, as long as the tables are what they were; what is kept
    is removed when the session's Python ends.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def _written(self) -> tuple[int, ...]:
        """When each table was last written: a table written anew in its place is another one."""
        if "written" not in self._made:
            times = []
            for t in TABLES:
                at, store = _file(self.spark, f"{self.sf_dir}/{t}.parquet")
                times.append(store.getFileStatus(at).getModificationTime())
            self._made["written"] = tuple(times)
        return self._made["written"]

    def _placed(self, table: str, key: str, nation: str, into: str, *columns: str) -> DataFrame:
        """Customers or suppliers with their city; the rows that a key has are numbered from 1 (`copy`)."""
        city = self.city.select("nk", F.col("city_id").alias(into))
        placed = getattr(self, table).join(city, F.col(nation) == F.col("nk")).select(key, *columns, into)
        order = Window.partitionBy(key).orderBy(into)
        return placed.withColumn(f"{key[0]}_copy", F.row_number().over(order)).where(f"{key} is not null")

    def _lines(self) -> DataFrame:
        """Lines of known orders with the year, what flows need of the customer, and both cities.

        A line without a known customer or supplier stays, its `c_copy` or `s_copy` null; one that has
        several is there for each, so whoever doesn't ask for them takes the first (1) alone.
        """
        suppliers = self._placed("supplier", "s_suppkey", "s_nationkey", "to_id")
        if suppliers.count() <= SUPPLIERS_SENT:
            suppliers = F.broadcast(suppliers)
        customers = self._placed("customer", "c_custkey", "c_nationkey", "from_id", "c_nationkey", "c_mktsegment")
        orders = self.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("int").alias("yr")).where("o_orderkey is not null")
        orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").drop("o_custkey", "c_custkey")
        lines = self.lineitem.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left")
        own = ["l_orderkey", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "to_id"]
        # What has few values is dealt as one number: four bits and the day, 0 for none.
        bits = [F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", F.col("s_copy").isNotNull(), F.col("s_copy") > 1]
        marks = sum(F.when(bit, 1 << i).otherwise(0) for i, bit in enumerate(bits)) + F.coalesce(F.day("l_shipdate"), F.lit(0)) * 16
        lines = lines.select(*own, marks.alias("marks")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        returned, finished, known, later = (F.col("marks").bitwiseAND(1 << i) > 0 for i in range(len(bits)))
        out = {"returned": returned, "finished": finished, "s_copy": F.when(known, F.when(later, 2).otherwise(1))}
        out["ship_day"] = F.nullif(F.floor(F.col("marks") / 16).cast("byte"), F.lit(0))
        return lines.withColumns(out).drop("l_orderkey", "o_orderkey", "marks")

    def _derived(self, name: str) -> DataFrame:
        """A fixture made from the tables and the fixtures that it names."""
        if name == "fx_lines":
            return self._lines()
        sql = OVER_LINES.get(name) or FIXTURES[name]
        for part in dict.fromkeys(re.findall(r"\bfx_\w+|\b(?:" + "|".join(TABLES) + r")\b", sql)):
            self._view(part)
        return self.spark.sql(sql)

    def _view(self, name: str) -> DataFrame:
        if name in self._made:
            return self._made[name]
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        else:
            key = (self.spark.sparkContext.applicationId, self.sf_dir, self._written(), name)
            if key not in _staged:
                df = self._derived(name)
                if name in STAGED:
                    path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
                    df.write.mode("append").parquet(forget_at_exit(self.spark, path), compression="zstd")
                    _staged[key] = path
            if key in _staged:
                df = self.spark.read.parquet(_staged[key])
        df.createOrReplaceTempView(name)
        self._made[name] = df
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if f"fx_{name}" in FIXTURES or name in TABLES:
            return self._view(f"fx_{name}" if f"fx_{name}" in FIXTURES else name)
        raise AttributeError(name)
