"""Boosted trees on candidate rows: binary for recall, by lambdas for ranking.

A round is a handful of Spark jobs whose results are small. Features are binned once (a byte each); a
level of a tree is one aggregation of the gradients by (node, feature, bin), added up map-side, of
which only the best split of each node comes back. Gradients and curvatures are whole multiples of
2^-20, so their sums don't depend on the order of rows: any partitioning, a lost executor or a training
that was resumed gives the same trees, bit for bit.

The model is a table of nodes. Scoring compiles the first so many trees of it into one column.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.functions.labels import graded_short, listed_gain
from tributary.operators.metrics import judged
from tributary.operators.ranking import QUERY, ranked
from tributary.plans.fixtures import forget_at_exit, shared_folder
from tributary.sources.ledger import committed, record

#: Gradients are whole multiples of 1 / UNIT.
UNIT = 1 << 20
KEYS = (*QUERY, "to_city")
_NODES = "tree int, node int, feature int, bin int, cut double, gain double, value double"


@dataclass
class Ensemble:
    """Nodes are numbered from 1, the children of n are 2n (up to the cut) and 2n + 1; a leaf has no
    feature, an inner node no value. history: the measure after each round; best: how many rounds gave
    the best one (all without a measure)."""

    features: list[str]
    cuts: list[list[float]]
    nodes: list[tuple] = field(default_factory=list)
    history: list[float] = field(default_factory=list)
    best: int = 0

    @property
    def rounds(self) -> int:
        return 1 + max((n[0] for n in self.nodes), default=-1)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, _NODES)

    def _tree(self, tree: int, below: Callable[[tuple], Column]) -> Column:
        own = {n[1]: n for n in self.nodes if n[0] == tree}

        def at(k: int) -> Column:
            n = own[k]
            return F.lit(n[6]) if n[2] is None else F.when(below(n), at(2 * k)).otherwise(at(2 * k + 1))

        return at(1)

    def column(self, first: int | None = None) -> Column:
        """The score of the first so many trees (the best rounds' if not said), over the features."""
        total = F.lit(0.0)
        for t in range(min(self.rounds, self.best if first is None else first)):
            total = total + self._tree(t, lambda n: F.col(self.features[n[2]]) <= F.lit(n[4]))
        return total

    def binned_tree(self, tree: int) -> Column:
        return self._tree(tree, lambda n: F.get("bins", F.lit(n[2])) <= n[3])

    def score(self, df: DataFrame, first: int | None = None, into: str = "score") -> DataFrame:
        return df.withColumn(into, self.column(first))

    def save(self, spark: SparkSession, path: str) -> str:
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        about = [(self.features, self.cuts, self.history, self.best)]
        spark.createDataFrame(about, "features array<string>, cuts array<array<double>>, history array<double>, best int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        return path


def load(spark: SparkSession, path: str) -> Ensemble:
    about = spark.read.parquet(f"{path}/about").first()
    nodes = [tuple(r) for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect()]
    return Ensemble(list(about["features"]), [list(c) for c in about["cuts"]], nodes, list(about["history"]), about["best"])


def from_mllib(model, features: list[str], folder: str) -> Ensemble:
    """MLlib's fitted boosted trees as a table of nodes: what MLlib writes of them is read back, each tree's
    weight times its leaves. The score is the margin. Splits by category are an error."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    model.write().overwrite().save(folder)
    weights = dict(enumerate(model.treeWeights))
    rows = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").collect()  # as many as the model has nodes
    own = {(r["treeID"], r["id"]): r for r in rows}
    nodes = []

    def walk(tree: int, k: int, number: int) -> None:
        r = own[tree, k]
        if r["leftChild"] < 0:
            nodes.append((tree, number, None, None, None, None, r["prediction"] * weights[tree]))
            return
        if r["split"]["numCategories"] >= 0:
            raise ValueError("a split by category")
        nodes.append((tree, number, r["split"]["featureIndex"], None, r["split"]["leftCategoriesOrThreshold"][0], r["gain"], None))
        walk(tree, r["leftChild"], 2 * number)
        walk(tree, r["rightChild"], 2 * number + 1)

    for tree in weights:
        walk(tree, 0, 1)
    return Ensemble(features, [], nodes, best=len(weights))


def importance(nodes: DataFrame, features: list[str], n: int = 20) -> DataFrame:
    """(feature, importance): the gains of a feature's splits added up, the n greatest."""
    named = F.get(F.array(*map(F.lit, features)), F.col("feature"))
    gains = nodes.where("feature is not null").groupBy(named.alias("feature")).agg(F.sum("gain").alias("importance"))
    return gains.orderBy(F.desc("importance"), "feature").limit(n)


# Objectives: each adds g and h, whole numbers, to rows with a score.


def _units(x: Column) -> Column:
    return F.round(x * UNIT).cast("long")


def binary(rows: DataFrame) -> DataFrame:
    """Log loss of `label` (0 or 1) with `weight`."""
    chance = 1 / (1 + F.exp(-F.col("score")))
    return rows.withColumns({"g": _units(F.col("weight") * (F.col("label") - chance)), "h": _units(F.col("weight") * chance * (1 - chance))})


def lambdas(truncation: int = 20) -> Callable[[DataFrame], DataFrame]:
    """LambdaRank: within a query, each pair of different relevance of which one is among the first
    `truncation` pulls its two rows apart, by how much NDCG would move if they changed places.

    `rnk` gives the relevance. A query's candidates are one list; pairs are made of at most
    `truncation` of them with all. Rows without a pair have gradient 0.
    """

    def gradients(rows: DataFrame) -> DataFrame:
        query = Window.partitionBy(*QUERY)
        gain = listed_gain(graded_short(F.col("rnk")))
        discount = lambda p: 1 / F.log2(p + 1.0)
        place = F.row_number().over(query.orderBy(F.desc("score"), "to_city"))
        ideal = F.row_number().over(query.orderBy(F.desc("gain"), "to_city"))
        rows = rows.withColumn("gain", gain).withColumns({"place": place, "ideal": ideal})
        best = F.sum(F.when(F.col("ideal") <= truncation, F.col("gain") * discount(F.col("ideal"))).otherwise(0.0)).over(query)
        rows = rows.withColumn("best", F.round(best, 9))
        own = rows.select(*KEYS, "score", "gain", "place", "best")
        first = own.where(F.col("place") <= truncation).select(*QUERY, *[F.col(c).alias(f"a_{c}") for c in ("to_city", "score", "gain", "place")])
        pairs = first.join(own, list(QUERY)).where("a_gain <> gain and best > 0 and place > a_place")
        up = F.col("a_gain") > F.col("gain")
        moved = F.abs((F.col("a_gain") - F.col("gain")) * (discount(F.col("a_place")) - discount(F.col("place")))) / F.col("best")
        chance = 1 / (1 + F.exp(F.when(up, F.col("a_score") - F.col("score")).otherwise(F.col("score") - F.col("a_score"))))
        pull, bend = _units(moved * chance), _units(moved * chance * (1 - chance))
        both = pairs.select(*QUERY, F.explode(F.array(
            F.struct(F.col("a_to_city").alias("to_city"), F.when(up, pull).otherwise(-pull).alias("g"), bend.alias("h")),
            F.struct(F.col("to_city"), F.when(up, -pull).otherwise(pull).alias("g"), bend.alias("h")))).alias("p"))
        sums = both.groupBy(*QUERY, "p.to_city").agg(F.sum("p.g").alias("g"), F.sum("p.h").alias("h"))
        return rows.drop("gain", "place", "ideal", "best").join(sums, list(KEYS), "left").fillna(0, ["g", "h"])

    return gradients


# Measures after a round, on the rows kept back: higher is better.


def recall_at(truth: DataFrame, k: int = 10) -> Callable[[DataFrame], float]:
    """Mean over the queries of the rows of recall@k, of min(k, size of the truth)."""

    def measure(rows: DataFrame) -> float:
        own = truth.join(rows.select(*QUERY).distinct(), list(QUERY), "left_semi")
        found = judged(ranked(rows), own, (k,), "least").agg(F.avg(f"recall_{k}")).first()[0]
        return round(found or 0.0, 9)

    return measure


def ndcg_at(truth: DataFrame, k: int = 10) -> Callable[[DataFrame], float]:
    def measure(rows: DataFrame) -> float:
        own = truth.join(rows.select(*QUERY).distinct(), list(QUERY), "left_semi")
        return round(judged(ranked(rows), own, (k,)).agg(F.avg(f"ndcg_{k}")).first()[0] or 0.0, 9)

    return measure


# Training.


def cut_points(rows: DataFrame, features: list[str], bins: int, accuracy: int = 50_000) -> list[list[float]]:
    """Up to bins - 1 quantiles of each feature; exact up to accuracy / 2 rows or so, near beyond."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, accuracy).alias(f) for f in features]).first()
    return [sorted(set(found[f] or [])) for f in features]


def _bins(features: list[str], cuts: list[list[float]]) -> Column:
    """How many cuts are below each feature's value."""
    below = lambda f, own: F.size(F.filter(F.array(*map(F.lit, own)).cast("array<double>"), lambda c: c < F.col(f)))
    return F.array(*[below(f, own).cast("byte") for f, own in zip(features, cuts)])


def _best_splits(rows: DataFrame, node: Column, penalty: float, least: float) -> list:
    """The best split of each node: exact sums up to each bin, a row a node."""
    real = lambda c: F.col(c) / UNIT
    cells = rows.select(node.alias("node"), "g", "h", F.posexplode("bins").alias("feature", "bin"))
    cells = cells.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    column = Window.partitionBy("node", "feature")
    upto = column.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumns({"gl": F.sum("g").over(upto), "hl": F.sum("h").over(upto), "ga": F.sum("g").over(column), "ha": F.sum("h").over(column)})
    cells = cells.withColumns({"gr": F.col("ga") - F.col("gl"), "hr": F.col("ha") - F.col("hl")})
    share = lambda g, h: real(g) * real(g) / (real(h) + penalty)
    gain = F.when((real("hl") >= least) & (real("hr") >= least), share("gl", "hl") + share("gr", "hr") - share("ga", "ha"))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc_nulls_last("gain"), "feature", "bin"))
    return cells.withColumn("gain", gain).withColumn("k", best).where("k = 1").collect()


def grow(rows: DataFrame, model: Ensemble, tree: int, depth: int, rate: float, penalty: float, least: float) -> None:
    """One tree on rows with bins, g and h; level by level, each one job."""
    value = lambda g, h: rate * (g / UNIT) / (h / UNIT + penalty)
    own, open_ = {}, [1]
    for level in range(depth):
        node = F.lit(1)
        for k in sorted(own):  # rows go down the splits made so far
            _, _, feature, at, *_ = own[k]
            if feature is not None:
                node = F.when(node == k, F.when(F.get("bins", F.lit(feature)) <= at, 2 * k).otherwise(2 * k + 1)).otherwise(node)
        found = {r["node"]: r for r in _best_splits(rows.withColumn("_node", node).where(F.col("_node").isin(open_)), F.col("_node"), penalty, least)}
        after = []
        for k in open_:
            r = found.get(k)
            if r is None:
                own[k] = (tree, k, None, None, None, None, 0.0)
            elif r["gain"] is None or r["gain"] <= 1e-6:
                own[k] = (tree, k, None, None, None, None, value(r["ga"], r["ha"]))
            else:
                own[k] = (tree, k, r["feature"], r["bin"], model.cuts[r["feature"]][r["bin"]], r["gain"], None)
                own[2 * k] = (tree, 2 * k, None, None, None, None, value(r["gl"], r["hl"]))
                own[2 * k + 1] = (tree, 2 * k + 1, None, None, None, None, value(r["gr"], r["hr"]))
                after += [2 * k, 2 * k + 1]
        open_ = after
        if not open_:
            break
    model.nodes += [own[k] for k in sorted(own)]


def fit(
    rows: DataFrame,
    features: list[str],
    objective: Callable[[DataFrame], DataFrame],
    rounds: int,
    depth: int = 3,
    rate: float = 0.1,
    bins: int = 16,
    penalty: float = 1.0,
    least: float = 1e-3,
    measure: Callable[[DataFrame], float] | None = None,
    patience: int | None = None,
    folder: str | None = None,
    every: int = 5,
) -> Ensemble:
    """Train up to `rounds` trees on the rows whose `held` is false.

    rows: yr, type_id, to_city, held, the features (a missing one counts as 0) and what the objective
    reads. `measure` is taken on the held rows after each round; with `patience`, training stops when
    so many rounds have not bettered it, and no later tree is grown. Every `every` rounds the nodes,
    the scores of all rows and the measures so far are written to `folder` and committed; a call with
    the same folder goes on after the latest round that was committed whole. Without a folder what is
    written goes when the application ends.
    """
    spark = rows.sparkSession
    place = folder or forget_at_exit(spark, f"{shared_folder(spark)}/boosting-{uuid.uuid4().hex}")
    done = max((int(r["what"]) for r in committed(spark, place).collect()), default=0)
    if done:
        model = load(spark, f"{place}/model-{done}")
        held = spark.read.parquet(f"{place}/scores-{done}")
    else:
        rows = rows.fillna(0, features)
        model = Ensemble(features, cut_points(rows.where("not held"), features, bins))
        kept = [c for c in (*KEYS, "held", "label", "weight", "rnk") if c in rows.columns]
        start = rows.select(*kept, _bins(features, model.cuts).alias("bins"), F.lit(0.0).alias("score"))
        start.write.mode("overwrite").parquet(f"{place}/scores-0")
        held = spark.read.parquet(f"{place}/scores-0")
    for r in range(model.rounds, rounds):
        if patience is not None and r - model.best >= patience:
            break
        path = f"{place}/gradients-{r}"
        objective(held.where("not held")).select("bins", "g", "h").write.mode("overwrite").parquet(path)
        grow(spark.read.parquet(path), model, r, depth, rate, penalty, least)
        held = held.withColumn("score", F.col("score") + model.binned_tree(r))
        if measure:
            model.history.append(measure(held.where("held")))
            if model.history[-1] > max(model.history[:-1], default=float("-inf")):
                model.best = r + 1
        else:
            model.best = r + 1
        if (r + 1) % every == 0:
            held.write.mode("overwrite").parquet(f"{place}/scores-{r + 1}")
            held = spark.read.parquet(f"{place}/scores-{r + 1}")
            model.save(spark, f"{place}/model-{r + 1}")
            record(spark, place, str(r + 1), len(model.nodes))
    return model


def choose(rows: DataFrame, features: list[str], objective: Callable[[DataFrame], DataFrame], settings: list[dict], measure: Callable[[DataFrame], float], **how) -> tuple[int, list[Ensemble]]:
    """Train with each setting; the one whose best measure on the held rows is highest, the first of equals."""
    models = [fit(rows, features, objective, measure=measure, **{**how, **s}) for s in settings]
    scores = [max(m.history) for m in models]
    return scores.index(max(scores)), models
