"""Fill-in-middle against a plain version, unit by unit, and back."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tributary.llm import fim

SCHEMA = "doc_id long, text string, n string, form string, output int, pattern string"


def _plain(doc_id, text, seed=1):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", text, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return doc_id, n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return doc_id, n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def _texts():
    rng = random.Random(3)
    signs = ["ab", "Q", " ", "\n", "\r", "é", "😀", "<", ">", "<S", "P>", "$1", "\\", " ", "\0", "1", "M>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    return [*texts, None, "", "a", "<", "<P>", "x<M>y", "a" * 200_000, "é1" * 100_000, " \n" * 50_000, texts[0], texts[0]]


@pytest.mark.parametrize("seed", [1, 8])
def test_cut_and_back(spark, seed):
    rows = [(k, t, "n", "form", 1, "(") for k, t in enumerate(_texts())]
    rows += [(None, "no id", None, None, None, None), (None, None, None, None, None, None), rows[4], rows[4]]
    done = fim.fill_in_middle(spark.createDataFrame(rows, SCHEMA).repartition(3), seed)
    got = done.select("*", fim.restore(F.col("output"), F.col("form")).alias("back")).collect()
    want = sorted((*_plain(r[0], r[1], seed), r[1] or "") for r in rows if r[0] is not None)
    assert sorted((r["doc_id"], r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"], r["back"]) for r in got if r["doc_id"] is not None) == want
    assert sorted(r["back"] for r in got if r["doc_id"] is None) == ["", "no id"]
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_shares_and_an_empty_table(spark):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("some words and more").alias("text"))
    counts = {r["form"]: r["count"] for r in fim.fill_in_middle(many).groupBy("form").count().collect()}
    assert abs(counts["plain"] / 20_000 - 0.1) < 0.01 and abs(counts["spm"] / 18_000 - 0.2) < 0.015
    assert fim.fill_in_middle(many.limit(0)).count() == 0


def test_one_projection_of_the_scan(spark):
    plan = fim.op13_fill_in_middle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and plan.count("regexp_count") + plan.count("regexp_extract_all") == 1
