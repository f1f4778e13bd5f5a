"""Chat formatting on the driver's conversations: no text is lost, a turn is one row, roles on held-out rows."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tributary.llm import chat

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def lines(spark):
    learned = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 != 2
    return chat.transcript_lines(spark.read.parquet(f"{DIR}/conversations.parquet"), learned).cache()


@pytest.fixture(scope="module")
def model(lines):
    return chat.learn(lines.where("learned"))


def _transcripts(spark, texts):
    rows = [(c, k, line) for c, text in enumerate(texts) for k, line in enumerate(text)]
    return spark.createDataFrame(rows, "conv_id long, line_no long, line string").repartition(3)


@pytest.mark.parametrize("segment", [2, 7, 512])
def test_every_line_is_rendered_at_any_segment(spark, lines, model, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    log = [f"{'Warning' if k % 3 else 'Error'}: the disk is full, try {k}" for k in range(1200)]
    odd = _transcripts(spark, [["User: look at this log", *log, "Assistant: it is full."], log, ["", "", "x"], ["Assistant:"]])
    own = lines.select("conv_id", "line_no", "line").unionByName(odd.select((F.col("conv_id") + 10**6).alias("conv_id"), "line_no", "line"))
    want, got = defaultdict(list), defaultdict(list)
    for r in own.orderBy("conv_id", "line_no").collect():
        want[r["conv_id"]].append(r["line"])
    turns = chat.parse_transcripts(own, model).orderBy("conv_id", "at_line").collect()
    for r in turns:
        assert r["rendered"] == f"<|{r['role']}|>\n{r['text']}\n<|end|>\n" and r["n_lines"] == r["text"].count("\n") + 1
        got[r["conv_id"]] += (r["marker"] + r["text"]).split("\n")
    assert got == want
    if segment != 512:  # the same turns, whatever the segments
        monkeypatch.setattr(chat, "SEGMENT", 512)
        assert sorted(map(repr, chat.parse_transcripts(own, model).collect())) == sorted(map(repr, turns))


@pytest.mark.parametrize("stop", ["", "."])
def test_a_marker_outweighs_a_closing_mark(spark, model, stop):
    said = [("User: hello there", "user"), ("Assistant: thanks", "assistant"), ("User: and now", "user"), ("Assistant: sure", "assistant")]
    got = chat.parse_transcripts(_transcripts(spark, [[line + stop for line, _ in said]]), model).orderBy("at_line").collect()
    assert [r["role"] for r in got] == [role for _, role in said]


def test_roles_of_held_out_conversations(lines, model):
    """Start and role of a turn both right, by whether its style is known and its marker there."""
    found = {(r["conv_id"], r["at_line"]): r["role"] for r in chat.parse_transcripts(lines, model).collect()}
    right = defaultdict(list)
    for r in lines.where("turn_line = 0 and not learned").select("conv_id", "line_no", "role", "style", "line").collect():
        style = "known" if r["style"] < 4 else "new" if r["style"] == 4 else "none"
        marked = any(r["line"].startswith(m) for own in chat.STYLES.values() for m in own)
        right[style, marked].append(found.get((r["conv_id"], r["line_no"])) == r["role"])
    share = {k: round(sum(v) / len(v), 3) for k, v in right.items()}
    print(share, {k: len(v) for k, v in right.items()})
    assert share["known", True] >= 0.97 and share["new", True] >= 0.6
