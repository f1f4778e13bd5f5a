"""Hard-negative mining by Kronecker-packed products (operator 12).

Vectors are whole numbers here: each component times a scale, rounded down. Components of several
candidates, raised by a bias so that none is negative, stand in separate fields of one wide integer;
one product with an anchor's component multiplies them all, and the sums over the components, less
what the biases put in, are the candidates' exact scores. The integer is as wide as a double is exact
(53 bits), so that sums of products are one matrix product; where fields don't fit, it is a Python
integer of any width.

All rows meet all anchors in blocks: rows are dealt into blocks of about BLOCK, anchors into blocks of
about ANCHORS, and each pair of blocks is one group, scored in tiles. A first pass over the rows of an
anchor's own label finds its positives, a second over the others the negatives in each positive's band.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.names import give_back
from tributary.llm.shared import stage, table

#: Rows of a block (fewer while there would be less than LEAST blocks a core), anchors of a block, and
#: scores of a tile.
BLOCK, LEAST, ANCHORS, TILE = 8192, 4, 1024, 1 << 20
#: Bits in which a double counts exactly; candidates in one Python integer; components up to here count as
#: narrow ones, and rows with larger ones are scored apart.
EXACT, TOGETHER, NARROW = 53, 8, 1 << 15
#: A missing vec_id while it is packed: it comes last, as a missing one should.
MISSING = np.iinfo(np.int64).max
_PACKED = "block long, n long, dims long, ids binary, labels binary, anchors binary, vectors binary"
_ANCHOR = "uid long, anchor_id long, label long, vector binary"


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors (floats), anchors by rows; beyond a long, its end."""
    out = np.zeros((len(anchors), len(rows)), np.int64)
    for a in _by_size(anchors):
        for r in _by_size(rows):
            if len(a) and len(r):
                out[np.ix_(a, r)] = _packed_products(anchors[a], rows[r])
    return out


def _by_size(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    narrow = np.abs(vectors).max(1, initial=0) <= NARROW
    return np.flatnonzero(narrow), np.flatnonzero(~narrow)


def _packed_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    n, dims = rows.shape
    if not dims:
        return np.zeros((len(anchors), n), np.int64)
    raise_a, raise_r = int(np.abs(anchors).max()), int(np.abs(rows).max())
    bits = (dims * 2 * raise_a * 2 * raise_r).bit_length() or 1
    exact = bits <= EXACT
    fields = EXACT // bits if exact else TOGETHER
    if not exact:
        whole = np.vectorize(int, otypes=[object])
        anchors, rows = whole(anchors), whole(rows)
    words = np.zeros((-(-n // fields), dims), rows.dtype)
    for k in range(fields):
        part = rows[k::fields] + raise_r
        words[: len(part)] += part * (1 << bits * k)
    sums = (anchors + raise_a) @ words.T
    if exact:
        sums = sums.astype(np.int64)
    out = np.empty((len(anchors), n), sums.dtype)
    for k in range(fields):
        field = (sums >> bits * k) & ((1 << bits) - 1)
        out[:, k::fields] = field[:, : out[:, k::fields].shape[1]]
    put_in = raise_r * anchors.sum(1)[:, None] + raise_a * rows.sum(1)[None] + dims * raise_a * raise_r
    if exact:
        return out - put_in.astype(np.int64)
    return np.clip(out - put_in, -MISSING, MISSING).astype(np.int64)


def _best(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of each line's n highest scores, in any order; of ties the first places."""
    m = scores.shape[1]
    if m <= n:
        return np.broadcast_to(np.arange(m), scores.shape)
    if np.abs(scores).max() < (1 << 62) // m:
        return np.argpartition(np.arange(m) - scores * m, n, axis=1)[:, :n]
    return np.argsort(-scores, axis=1, kind="stable")[:, :n]


def _first(scores: np.ndarray, group: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Which entries are among the first n of their group: higher scores first, ties by place."""
    order = np.lexsort((place, -scores, group))
    sorted_group = group[order]
    starts = np.flatnonzero(np.diff(sorted_group, prepend=sorted_group[:1] - 1))
    within = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[within < n]


def _pack(batches):
    """One row for all rows of the task's partition that take part, in order of vec_id."""
    ids, labels, anchors, vectors = [], [], [], []
    for batch in batches:
        lists = batch.column("embedding")
        lengths = np.asarray(lists.value_lengths().fill_null(0))
        flat = lists.flatten().cast(pa.float64())
        of = np.repeat(np.arange(len(lists)), lengths)
        values = flat.to_numpy(zero_copy_only=False)
        good = np.asarray(lists.is_valid()) & np.asarray(batch.column("label").is_valid())
        good[of[~np.isfinite(values) | np.asarray(flat.is_null())]] = False
        matrix = np.zeros((len(lists), int(lengths.max(initial=0))))
        matrix[of, np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.where(np.isfinite(values), values, 0)
        ids.append(np.asarray(batch.column("vec_id").cast(pa.int64()).fill_null(MISSING))[good])
        labels.append(np.asarray(batch.column("label").cast(pa.int64()).fill_null(0))[good])
        anchors.append(np.asarray(batch.column("anchor").fill_null(False))[good])
        vectors.append(np.floor(matrix[good]))
    if not ids or not sum(map(len, ids)):
        return
    dims = max(v.shape[1] for v in vectors)
    vectors = np.concatenate([np.pad(v, ((0, 0), (0, dims - v.shape[1]))) for v in vectors])
    ids, labels, anchors = map(np.concatenate, (ids, labels, anchors))
    order = np.argsort(ids, kind="stable")
    kind = np.int16 if np.abs(vectors).max(initial=0) < 1 << 15 else np.float64
    row = (TaskContext.get().partitionId(), len(ids), dims, ids[order].tobytes(), labels[order].tobytes(), np.packbits(anchors[order]).tobytes(), vectors[order].astype(kind).tobytes())
    yield pa.RecordBatch.from_pydict({c.split()[0]: [v] for c, v in zip(_PACKED.split(", "), row)}, pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.binary()) for c in _PACKED.split(", ")]))


def _unpacked(row) -> tuple[np.ndarray, ...]:
    """ids, labels, vectors and numbers (unique over all blocks) of a packed row."""
    n, dims = int(row["n"]), int(row["dims"])
    kind = np.int16 if len(row["vectors"]) == 2 * n * dims else np.float64
    vectors = np.frombuffer(row["vectors"], kind).reshape(n, dims).astype(np.float64)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), vectors, (int(row["block"]) << 32) + np.arange(n)


def _anchors(frames):
    for frame in frames:
        for _, row in frame.iterrows():
            ids, labels, vectors, uids = _unpacked(row)
            own = np.flatnonzero(np.unpackbits(np.frombuffer(row["anchors"], np.uint8), count=len(ids)))
            yield pd.DataFrame({"uid": uids[own], "anchor_id": ids[own], "label": labels[own], "vector": [vectors[k].tobytes() for k in own]})
        give_back()


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    """Vectors of bytes, filled with zeros to a width."""
    rows = [np.frombuffer(v) for v in vectors]
    dims = max(dims, max(map(len, rows)))
    return np.stack([np.pad(v, (0, dims - len(v))) for v in rows])


def _wider(vectors: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(vectors, ((0, 0), (0, dims - vectors.shape[1])))


def _tiles(n_anchors: int, n_rows: int):
    step = max(1, TILE // max(1, n_rows))
    return ((k, min(k + step, n_anchors)) for k in range(0, n_anchors, step))


def mine_hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, band: tuple[int, int] = (80, 100), scale: int = 256) -> DataFrame:
    """For each anchor and each of its best `positives` rows of the same label: the best `negatives` rows of
    other labels whose score is between band[0] and band[1] per cent of the positive's.

    rows: vec_id, embedding (array), label; `anchor` is a condition on them. Each component is multiplied
    by `scale` and rounded down; a score is an exact inner product. Gives anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score. Rows with a null label, a null vector or a component that
    is null or not finite take no part; a null vec_id is one, last among ties; shorter vectors count as
    filled with zeros; of rows that repeat each is an anchor, a positive and a negative of its own, ties
    among them fall either way; a score beyond a long counts as its end; other columns are ignored; an
    empty table gives none. Each block holds BLOCK rows and ANCHORS anchors at most about, whatever their
    labels or ids; what blocks send each other is the rows once for each block of anchors and the anchors
    once for each block of rows.
    """
    spark = rows.sparkSession
    total = rows.count()
    blocks = max(1, -(-total // BLOCK), min(LEAST * spark.sparkContext.defaultParallelism, total // 256))
    scaled = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < float("inf"), x.cast("double") * scale))
    whole = rows.select("vec_id", "label", scaled.alias("embedding"), anchor.alias("anchor"))
    packed = stage(whole.repartition(blocks).mapInArrow(_pack, _PACKED), "vectors")
    anchors = stage(packed.mapInPandas(_anchors, _ANCHOR), "anchors")
    groups = max(1, -(-anchors.count() // ANCHORS))
    dealt = packed.drop("anchors").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def met(df: DataFrame, work, schema: str) -> DataFrame:
        """All blocks of rows with all blocks of anchors."""
        every = df.withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        return dealt.groupBy("block", "group").cogroup(every.groupBy("block", "group")).applyInPandas(work, schema)

    near_schema = "uid long, anchor_id long, score long, positive long, positive_id long"

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            ids, labels, vectors, uids = _unpacked(left.iloc[0])
            mine = _matrix(right["vector"], vectors.shape[1])
            vectors = _wider(vectors, mine.shape[1])
            for label, own in right.reset_index(drop=True).groupby("label").indices.items():
                same = np.flatnonzero(labels == label)
                for a, b in _tiles(len(own), len(same)):
                    who = own[a:b]
                    score = products(mine[who], vectors[same])
                    uid = right["uid"].to_numpy()[who]
                    order = _best(score, positives + 1)  # the anchor itself may be there
                    k, j = np.repeat(np.arange(len(who)), order.shape[1]), order.ravel()
                    other = uids[same[j]] != uid[k]
                    k, j = k[other], j[other]
                    found.append(pd.DataFrame({"uid": uid[k], "anchor_id": right["anchor_id"].to_numpy()[who[k]], "score": score[k, j], "positive": uids[same[j]], "positive_id": ids[same[j]]}))
        give_back()
        return pd.concat(found) if found else pd.DataFrame(columns=[c.split()[0] for c in near_schema.split(", ")])

    best = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "positive_id", "positive"))
    close = met(anchors, near, near_schema).withColumn("place", best).where(F.col("place") <= positives)
    close = close.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("place", "score", "positive_id"))).alias("close"))  # `positives` at most
    asked = anchors.join(close.withColumnRenamed("uid", "own"), F.col("uid") == F.col("own")).drop("own")
    asked = stage(asked.select("uid", "anchor_id", "label", "vector", "close.score", "close.positive_id"), "positives")
    far_schema = "uid long, anchor_id long, place int, positive_id long, positive_score long, negative long, negative_id long, negative_score long"

    def far(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            ids, labels, vectors, uids = _unpacked(left.iloc[0])
            mine = _matrix(right["vector"], vectors.shape[1])
            vectors = _wider(vectors, mine.shape[1])
            own, uid, anchor_id = (right[c].to_numpy() for c in ("label", "uid", "anchor_id"))
            most = max(map(len, right["score"]))
            top, low, told = (np.zeros((len(right), most), np.int64) for _ in range(3))
            there = np.zeros((len(right), most), bool)
            for k, (score, positive) in enumerate(zip(right["score"], right["positive_id"])):
                there[k, : len(score)], told[k, : len(score)] = True, positive
                for p, s in enumerate(map(int, score)):
                    top[k, p], low[k, p] = min(s * band[1] // 100, MISSING), max(-(-s * band[0] // 100), -MISSING)
            scored = np.array([list(map(int, s)) + [0] * (most - len(s)) for s in right["score"]], np.int64)
            usable = there & (low <= top)
            floor, ceiling = np.where(usable, low, MISSING).min(1), np.where(usable, top, -MISSING).max(1)
            for a, b in _tiles(len(right), len(ids)):
                score = products(mine[a:b], vectors)
                k, j = np.nonzero((score >= floor[a:b, None]) & (score <= ceiling[a:b, None]) & (own[a:b, None] != labels[None]))
                s, k = score[k, j], k + a
                for p in range(most):
                    within = np.flatnonzero(usable[k, p] & (low[k, p] <= s) & (s <= top[k, p]))
                    within = within[_first(s[within], k[within], j[within], negatives)]
                    x, y = k[within], j[within]
                    found.append(pd.DataFrame({"uid": uid[x], "anchor_id": anchor_id[x], "place": p, "positive_id": told[x, p], "positive_score": scored[x, p], "negative": uids[y], "negative_id": ids[y], "negative_score": s[within]}))
        give_back()
        return pd.concat(found) if found else pd.DataFrame(columns=[c.split()[0] for c in far_schema.split(", ")])

    rank = F.row_number().over(Window.partitionBy("uid", "place").orderBy(F.desc("negative_score"), "negative_id", "negative"))
    mined = met(asked, far, far_schema).withColumn("rank", rank).where(F.col("rank") <= negatives)
    told = [F.nullif(F.col(c), F.lit(int(MISSING))).alias(c) for c in ("anchor_id", "positive_id", "negative_id")]
    return mined.select(told[0], told[1], "rank", told[2], "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


OP12_SQL = """with kept as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, row_number() over () as uid,
  list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (select a.uid, a.vec_id as anchor_id, b.uid as other, b.vec_id as other_id, a.label = b.label as same, cast(list_inner_product(a.q, b.q) as bigint) as score
  from kept a join kept b on a.uid <> b.uid where a.vec_id % 100 = 0),
close as (select * from (select *, row_number() over (partition by uid order by score desc, other_id, other) as place from scores where same) p where place <= 5),
far as (select c.anchor_id, c.other_id as positive_id, s.other_id as negative_id, c.score as positive_score, s.score as negative_score,
  row_number() over (partition by c.uid, c.other order by s.score desc, s.other_id, s.other) as rank
  from close c join scores s on s.uid = c.uid and not s.same and 80 * c.score <= 100 * s.score and 100 * s.score <= 100 * c.score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from far where rank <= 5"""
