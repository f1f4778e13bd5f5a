"""Hard negatives against a plain version: every score by Python's integers, every choice by sorting."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, uid long, score string, block int"


def _plain(rows, positives=5, n=5):
    part = [(v, [math.floor(256 * x) for x in e], lab) for v, e, lab, *_ in rows if lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    score = lambda a, b: sum(x * y for x, y in zip(a[1], b[1]))
    last = lambda v: math.inf if v is None else v
    out = []
    for k, a in enumerate(part):
        if a[0] is None or a[0] % 100:
            continue
        others = sorted(((-score(a, b), last(b[0]), b[2]) for j, b in enumerate(part) if j != k), key=lambda t: t[:2])
        close = [o for o in others if o[2] == a[2]][:positives]
        for s, pid, _ in close:
            band = [o for o in others if o[2] != a[2] and 80 * -s <= 100 * -o[0] <= 100 * -s][:n]
            out += [(a[0], None if pid == math.inf else pid, r, None if o[1] == math.inf else o[1], -s, -o[0]) for r, o in enumerate(band, 1)]
    return sorted(out, key=repr)


def _rows(rng):
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(9)], rng.choice([0, 0, 0, 1, 2, k]), 1, "s", 2) for k in range(0, 900, 3)]
    hot = [0.5, 0.25, 0.1, 0.0, 0.0, 0.0, 0.3, 0.2, 0.4]
    rows += [(10_000 + k, hot, k % 3, 1, "s", 2) for k in range(120)]  # a vector with many copies: ties
    rows += [rows[0], rows[100], rows[100], (None, hot, 1, None, None, None), (None, hot, 2, None, None, None)]
    rows += [(700, None, 1, 1, "s", 2), (800, hot, None, 1, "s", 2), (1100, [0.1, None], 1, 1, "s", 2), (1200, [math.nan, 1.0], 1, 1, "s", 2), (1300, [math.inf], 1, 1, "s", 2)]
    rows += [(1400, [], 1, 1, "s", 2), (1500, [1.0, 2.0], 1, 1, "s", 2), (1600, [*hot, 9.0, -3.0], 0, 1, "s", 2), (1700, [-x for x in hot], 2, 1, "s", 2), (-300, hot, 0, 1, "s", 2)]
    return rows + [(2000 + k, [x * 4e5 for x in hot], k % 2, 1, "s", 2) for k in range(0, 200, 50)] + [(2300, [3e5 * x for x in hot], 0, 1, "s", 2), (2301, [2.9e5 * x for x in hot], 1, 1, "s", 2)]


@pytest.mark.parametrize("block, anchors", [(8192, 1024), (40, 3)])
def test_all_choices(spark, monkeypatch, block, anchors):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    rows = _rows(random.Random(5))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = negatives.mine_hard_negatives(frame, F.col("vec_id") % 100 == 0).collect()
    want = _plain(rows)
    assert sorted(map(tuple, got), key=repr) == want and len(want) > 100
    two = negatives.mine_hard_negatives(frame, F.col("vec_id") % 100 == 0, positives=2, negatives=3).collect()
    assert sorted(map(tuple, two), key=repr) == _plain(rows, 2, 3)


def test_products_are_exact():
    """Small fields, wide ones, and ones that no double holds, all in one block too."""
    rng = np.random.default_rng(1)
    for size in (0, 4, 200, 30_000, 1e7, 1e11, 1e15):
        for rare in (1, 1e6):
            a, r = np.floor(rng.normal(size=(6, 17)) * size), np.floor(rng.normal(size=(29, 17)) * size)
            r[3] *= rare
            want = [[max(-negatives.MISSING, min(negatives.MISSING, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in r] for p in a]
            assert negatives.products(a, r).tolist() == want


def test_nothing_to_mine(spark):
    frame = spark.createDataFrame(_rows(random.Random(1))[:40], SCHEMA)
    none = negatives.mine_hard_negatives(frame.limit(0), F.col("vec_id") % 100 == 0)
    assert none.collect() == [] and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert negatives.mine_hard_negatives(frame.where("vec_id % 100 <> 0"), F.col("vec_id") % 100 == 0).collect() == []
    assert negatives.mine_hard_negatives(frame.withColumn("label", F.lit(1)), F.col("vec_id") % 100 == 0).collect() == []
