"""Registered queries that learn, and the whole of their training as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary import boosting_sql as bsql
from tributary.catalog import CODES, CROSS, PAIR_COLUMNS, VACANCIES, WAGES, _feature_sql, fresh, pairs, query
from tributary.functions import labels as lab
from tributary.operators import history as hist
from tributary.operators import metrics as met
from tributary.operators import ranking as rk
from tributary.plans import boosting, pipelines
from tributary.plans.fixtures import Fixtures

#: Every feature that candidate rows have: of the person, the pair, both together, and earlier flows.
FEATURES = [*CODES, *PAIR_COLUMNS, *CROSS, "hist_log_flow", "hist_share", "hist_share_3"]

_WEIGHT = "case when rnk between 1 and 5 then 40 when rnk between 6 and 20 then 30 else 1 end"
_ROWS = f"""l_flow as (select yr, type_id, to_city, n, cast(n as double) / sum(n) over (partition by yr, type_id) as share from fx_flows),
l_past as (select yr + k as yr, type_id, to_city, sum(case when k = 1 then n end) as n, sum(case when k = 1 then share end) as share, sum(n) as three, sum(sum(n)) over (partition by yr + k, type_id) as everything
  from l_flow cross join (values (1), (2), (3)) s(k) group by 1, 2, 3),
l_rows as materialized (select row_number() over (order by f.yr, f.type_id, f.to_city) as rid, f.yr, f.type_id, f.to_city, f.rnk, f.label, f.weight, f.yr = 1999 as held, {', '.join(f'round(cast(f.{c} as double) + 1e-9, 6) as {c}' for c in FEATURES[:-3])},
  round(ln(1 + coalesce(h.n, 0)) + 1e-9, 6) as hist_log_flow, round(coalesce(h.share, 0) + 1e-9, 6) as hist_share, round(coalesce(cast(h.three as double) / h.everything, 0) + 1e-9, 6) as hist_share_3
  from ({_feature_sql(f"select *, case when rnk between 1 and 10 then 1 else 0 end as label, {_WEIGHT} as weight from fx_base", "b.yr, b.type_id, b.from_city, b.to_city, b.rnk, b.label, b.weight")}) f
  left join l_past h on h.yr = f.yr and h.type_id = f.type_id and h.to_city = f.to_city where f.yr between 1996 and 2001),
l_train as materialized (select * from l_rows where yr < 2000)"""


def _sql(result: str, *parts: str) -> str:
    return f"with {', '.join([_ROWS, *parts])} {result}"


def learning_rows(fx: Fixtures) -> DataFrame:
    """Candidate rows of 1996 to 2001 with all features; the year 1999 is held back, later ones are new."""
    base = fx.base.withColumns({"label": F.col("rnk").between(1, 10).cast("int"), "weight": lab.weight_recall(F.col("rnk"))}).where("yr between 1996 and 2001")
    rows = hist.with_past(pipelines.with_features(base, pairs(fx), WAGES, VACANCIES), fx.flows)
    rounded = {c: F.round(F.col(c).cast("double") + 1e-9, 6) for c in FEATURES}
    return rows.select("yr", "type_id", "to_city", "rnk", "label", "weight", (F.col("yr") == 1999).alias("held"), *[v.alias(c) for c, v in rounded.items()])


def _training(fx: Fixtures) -> DataFrame:
    return learning_rows(fx).where("yr < 2000")


def _new(fx: Fixtures) -> DataFrame:
    return learning_rows(fx).where("yr >= 2000")


#: How much the registered models learn: enough rounds to tell right from wrong.
RECALL, RANK = {"rounds": 3, "depth": 3, "rate": 0.2}, {"rounds": 4, "depth": 3, "rate": 0.2}


def _boosted(p: str, objective: str, rounds: int, depth: int, rate: float) -> str:
    """Training on the rows before 2000, scores of all rows: a row that is not trained on is held here."""
    rows = f"{p}r as materialized (select * exclude (held), yr >= 1999 as held from l_rows)"
    return rows + ",\n" + bsql.boosted(p, f"{p}r", FEATURES, objective, rounds, depth, rate)


_TOP = "select yr, type_id, to_city, pos, score from (select *, row_number() over (partition by yr, type_id order by score desc, to_city) as pos from {s} where yr >= 2000) t where pos <= 10"


@query("yr:i type_id:s to_city:i pos:i score:d", _sql(_TOP.format(s="t_s3"), _boosted("t_", "binary", **RECALL)))
def recall_model(fx):
    """Boosted trees on every feature; the best ten candidates of each query of later years."""
    model = boosting.fit(_training(fx), FEATURES, boosting.binary, **RECALL)
    return rk.top_k(model.score(_new(fx)), 10)


@query("yr:i type_id:s pos:i to_city:i score:d", _sql(_TOP.format(s="t_s3"), _boosted("t_", "binary", **RECALL)))
def saved_model(fx):
    """The fitted trees are written, read back and used."""
    folder = boosting.fit(_training(fx), FEATURES, boosting.binary, **RECALL).save(fx.spark, fresh(fx, "model"))
    return rk.top_k(boosting.load(fx.spark, folder).score(_new(fx)), 10)


_RECALL = """select avg(cast(hits as double) / least(10, gt)) from (select t.yr, t.type_id, count(*) as gt, sum(case when pos <= 10 then 1 else 0 end) as hits
  from fx_truth t left join (select yr, type_id, to_city, row_number() over (partition by yr, type_id order by score desc, to_city) as pos from {s} where yr = 1999) p
  on p.yr = t.yr and p.type_id = t.type_id and p.to_city = t.to_city where t.yr = 1999 group by 1, 2) q"""
PATIENT = {"rounds": 5, "depth": 2, "rate": 0.5}


@query("yr:i type_id:s to_city:i pos:i score:d rounds:i", _sql(
    f"select yr, type_id, to_city, pos, score, rounds from (select *, row_number() over (partition by yr, type_id order by score desc, to_city) as pos from ({' union all '.join(f'select yr, type_id, to_city, score, {r} as rounds from p_s{r}, p_best where best = {r} and yr >= 2000' for r in range(1, 6))}) a) t where pos <= 10",
    _boosted("p_", "binary", **PATIENT), bsql.best_round("p_", 5, 1, _RECALL)))
def recall_model_prefix(fx):
    """Training stops when a round hasn't bettered recall@10 of the year held back; the rounds up to the best are used."""
    model = boosting.fit(_training(fx), FEATURES, boosting.binary, measure=boosting.recall_at(fx.truth), patience=1, **PATIENT)
    return rk.top_k(model.score(_new(fx)).withColumn("rounds", F.lit(model.best)), 10)


@query("feature:s importance:d", _sql(
    f"select [{', '.join(repr(f) for f in FEATURES)}][fi + 1] as feature, sum(gain) as importance from ({bsql.splits('t_', RECALL['rounds'], RECALL['depth'])}) g group by 1 order by importance desc, feature limit 15",
    _boosted("t_", "binary", **RECALL)))
def feature_importance(fx):
    """The fifteen features whose splits gain most."""
    model = boosting.fit(_training(fx), FEATURES, boosting.binary, **RECALL)
    return boosting.importance(model.table(fx.spark), FEATURES, 15)


@query("yr:i type_id:s to_city:i rank_pos:i score:d", _sql(
    """select yr, type_id, to_city, rank_pos, score from (select *, row_number() over (partition by yr, type_id order by score desc, to_city) as rank_pos
  from (select *, row_number() over (partition by yr, type_id order by hist_log_flow desc, to_city) as recalled from k_s4 where yr >= 2000) a where recalled <= 15) t where rank_pos <= 10""",
    _boosted("k_", "lambdas", **RANK)))
def ranking_model(fx):
    """LambdaRank over the fifteen candidates with last year's greatest flows."""
    model = boosting.fit(_training(fx), FEATURES, boosting.lambdas(), **RANK)
    recalled = rk.ranked(_new(fx).withColumn("score", F.col("hist_log_flow")), "score", "recall_pos").where("recall_pos <= 15")
    return rk.ranked(model.score(recalled.drop("score")), "score", "rank_pos").where("rank_pos <= 10")


@query("yr:i pairs:i pull:i bend:i", _sql(
    "select yr, count(*) as pairs, sum(abs(g)) as pull, sum(h) as bend from l_g0 join l_s0 using (rid) group by yr",
    "l_s0 as materialized (select *, hist_log_flow as score from l_train)", bsql._lambdas("l_", 0)))
def lambda_gradients(fx):
    """One round's pulls and curvatures, from last year's flows as scores; rows held back have none."""
    rows = _training(fx).where("not held").withColumn("score", F.col("hist_log_flow"))
    found = boosting.lambdas()(rows)
    return found.groupBy("yr").agg(F.count("*").alias("pairs"), F.sum(F.abs("g")).alias("pull"), F.sum("h").alias("bend"))


_MEASURED = """select avg(cast(h5 as double) / least(5, gt)) as recall_5, avg(cast(h10 as double) / least(10, gt)) as recall_10, avg(cast(h20 as double) / least(20, gt)) as recall_20
  from (select t.yr, t.type_id, count(*) as gt, sum(case when pos <= 5 then 1 else 0 end) as h5, sum(case when pos <= 10 then 1 else 0 end) as h10, sum(case when pos <= 20 then 1 else 0 end) as h20
  from fx_truth t left join (select yr, type_id, to_city, row_number() over (partition by yr, type_id order by score desc, to_city) as pos from t_s3 where yr >= 2000) p
  on p.yr = t.yr and p.type_id = t.type_id and p.to_city = t.to_city where t.yr >= 2000 group by 1, 2) q"""


@query("recall_5:d recall_10:d recall_20:d", _sql(_MEASURED, _boosted("t_", "binary", **RECALL)))
def model_validation(fx):
    scored = boosting.fit(_training(fx), FEATURES, boosting.binary, **RECALL).score(_new(fx))
    return met.judged(rk.ranked(scored), fx.truth.where("yr >= 2000"), (5, 10, 20), "least").agg(*[F.avg(f"recall_{k}").alias(f"recall_{k}") for k in (5, 10, 20)])


SETTINGS = [{"depth": 1, "rate": 0.3}, {"depth": 3, "rate": 0.3}]


@query("setting:i best_recall:d chosen:i", _sql(
    "select setting, best_recall, case when setting = (select min(setting) from c_all where best_recall = (select max(best_recall) from c_all)) then 1 else 0 end as chosen from c_all",
    *[_boosted(f"c{k}_", "binary", rounds=2, **s) for k, s in enumerate(SETTINGS)],
    "c_all as materialized (" + " union all ".join(f"select {k} as setting, greatest(({_RECALL.format(s=f'c{k}_s1')}), ({_RECALL.format(s=f'c{k}_s2')})) as best_recall" for k in range(2)) + ")"))
def model_choice(fx):
    """Of two settings the one with the better recall@10 on the year held back."""
    chosen, models = boosting.choose(_training(fx), FEATURES, boosting.binary, SETTINGS, boosting.recall_at(fx.truth), rounds=2)
    return fx.spark.createDataFrame([(k, max(m.history), int(k == chosen)) for k, m in enumerate(models)], "setting int, best_recall double, chosen int")
