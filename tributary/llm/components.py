"""Connected components of a graph given by its edges, by star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.shared import BROADCAST_ROWS, stage

#: Edges that a task contracts at a time.
HELD = 500_000


def _stars(edges: np.ndarray) -> np.ndarray:
    """Each node of some edges with the least node it reaches by them, itself left out."""
    nodes, at = np.unique(edges, return_inverse=True)
    parent = np.arange(len(nodes))
    a, b = at.reshape(-1, 2).T
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        if (low == high).all():
            break
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return np.column_stack([nodes[child], nodes[parent[child]]])


def _contracted(batches):
    held, n = [], 0

    def flush():
        star = _stars(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(star[:, 0], pa.int64()), pa.array(star[:, 1], pa.int64())], names=["v", "m"])

    for batch in batches:
        held.append(np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        n += batch.num_rows
        if n >= HELD:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b: long) to (id, component): each linked node with its component's least node.

    Tasks first contract the edges they hold to stars. Then two steps alternate: every node gives
    its larger neighbours to its least one, and every node gives its smaller neighbours to the
    least of them; till each node has one smaller neighbour, which has none. Loops, repeated edges
    and nulls (left out) are allowed; no edges give an empty result. Each round is written to the
    shared folder, in files that follow the number of edges, so a lost executor costs one round.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    now = stage(edges.mapInArrow(_contracted, "v long, m long").distinct(), "edges")
    for _ in range(most_rounds):
        n = now.count()
        few = F.broadcast if 2 * n <= BROADCAST_ROWS else (lambda df: df)  # no more nodes than that
        if n == now.select("v").distinct().count() and now.join(few(now.select(F.col("v").alias("m"))), "m", "left_semi").isEmpty():
            return now.select(F.col("v").alias("id"), F.col("m").alias("component")).unionByName(now.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct())
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(now.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("w > u").join(few(least), "u").select(F.col("w").alias("v"), "m").distinct()
        best = large.groupBy("v").agg(F.min("m").alias("best"))
        given = large.join(few(best), "v").where("m <> best").select(F.col("m").alias("v"), F.col("best").alias("m"))
        after = best.select("v", F.col("best").alias("m")).unionByName(given).distinct()
        now = stage(after.coalesce(max(8, n // HELD)), "edges")
    raise RuntimeError("components did not settle")
