"""Chat formatting: a hidden Markov model recovers the roles of a transcript's lines (operator 3).

States are (role, is the turn's first line). A line is observed through its speaker marker, its
length and its closing mark. Counts over labelled transcripts give the probabilities and the names
that markers carry; Viterbi gives the likeliest roles; runs of lines are then rendered as canonical
turns. Of what is parsed only the lines and their order are known: no turns, no roles.

Long conversations are cut into segments of lines. Each segment gives the max-plus product of its
lines (a square of the number of states), the segments' products of a conversation give the states
at their seams, and each segment is then decoded between its two seams: exactly Viterbi's path, with
no conversation in one task as a whole. A turn that a seam cuts is put together again before it is
rendered; of the pieces only those at seams are moved for that.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.shared import spread, stage, table

ROLES = ("system", "user", "assistant")
STATES = [(role, begins) for role in ROLES for begins in (True, False)]
#: Lines of a segment.
SEGMENT = 512
#: A speaker marker of any name: a few words, marks around them that close, then a blank or the line's end.
_MARKER = re.compile(r"\s*[<\[(*#>|-]{0,4}\s*([A-Za-z][A-Za-z ]{0,18}?)\s*(?::[*\])|]{0,3}|[>\])|]{1,3}:?)(?:\s+|$)")
_LENGTHS = (0, 40, 120, 300, 700)
#: Share of all markers that an unknown name is taken to be; what is added to each count of a marker; and
#: how many lines of any role are added to a role's own counts of length and closing mark.
UNKNOWN, ADDED, POOLED = 0.05, 0.02, 20


def split_marker(line: str) -> tuple[str | None, str]:
    """The name that a line's marker gives (None without one) and the rest of the line."""
    m = _MARKER.match(line)
    return (m.group(1).lower(), line[m.end() :]) if m else (None, line)


def observed(line: str) -> tuple[str | None, int, int]:
    """Marker's name, length class and whether the line closes like a sentence."""
    name, rest = split_marker(line)
    return name, sum(len(rest) > n for n in _LENGTHS), int(rest.rstrip()[-1:] in ".!?")


@dataclass
class Model:
    """Natural logarithms of the probabilities; names: of the markers that are told apart. A marker is
    0 (none), 1 (of an unknown name) or 2 + its name's place."""

    start: np.ndarray
    move: np.ndarray
    names: dict[str, int]
    emit: tuple[np.ndarray, ...]

    def emissions(self, lines: list[str]) -> np.ndarray:
        seen = [observed(line) for line in lines]
        seen = np.array([(0 if name is None else self.names.get(name, 1), size, closed) for name, size, closed in seen]).reshape(-1, len(self.emit))
        return sum(table[:, seen[:, k]].T for k, table in enumerate(self.emit))


def learn(lines: DataFrame, least: int = 5) -> Model:
    """From counts of labelled lines (conv_id, turn, turn_line, line, role). Counts of lengths and closing
    marks are filled up with POOLED lines of all roles, so that a role of which little is known is not
    told by them against its marker.

    A marker's name is told apart if it stands on a thousandth of the lines, `least` at least, so
    their number is bounded; all other names are one, which is taken to begin turns as often as
    known names do and to belong to any role.
    """

    def count(batches):
        for pdf in batches:
            seen = [(*observed(line or ""), role, no == 0) for line, role, no in zip(pdf["line"], pdf["role"], pdf["turn_line"]) if role in ROLES]
            yield pd.DataFrame(seen, columns=["marker", "size", "closed", "role", "begins"])

    seen = lines.select("line", "role", "turn_line").mapInPandas(count, "marker string, size int, closed int, role string, begins boolean")
    seen = stage(seen.groupBy("role", "begins", "marker", "size", "closed").count(), "observed")
    often = F.col("count") >= F.greatest(F.lit(least), F.col("all") / 1000)
    total = seen.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("all"))
    found = seen.where("marker is not null").groupBy("marker").agg(F.sum("count").alias("count")).crossJoin(total).where(often)  # a row: the total
    names = {r["marker"]: k for k, r in enumerate(found.orderBy("marker").collect(), 2)}  # at most a thousand
    emit = tuple(np.full((len(STATES), n), least) for n, least in ((len(names) + 2, ADDED), (len(_LENGTHS) + 1, 0.0), (2, 0.0)))
    known = F.when(F.col("marker").isNull(), "").when(F.col("marker").isin(*names), F.col("marker")).otherwise("\n")
    for r in seen.groupBy("role", "begins", known.alias("marker"), "size", "closed").agg(F.sum("count").alias("count")).collect():
        at = {"": 0, "\n": 1}.get(r["marker"]) if r["marker"] in ("", "\n") else names[r["marker"]]
        for k, v in enumerate((at, r["size"], r["closed"])):
            emit[k][STATES.index((r["role"], r["begins"])), v] += r["count"]
    for begins in (True, False):
        own = [k for k, s in enumerate(STATES) if s[1] == begins]
        share = UNKNOWN * emit[0][own, 2:].sum() / emit[0][own].sum()
        emit[0][own, 1] = ADDED + share / (1 - share) * (emit[0][own].sum(1) - emit[0][own, 1])  # alike for all roles
        for table in emit[1:]:
            every = table[own].sum(0) + 1
            table[own] += POOLED * every / every.sum()
    turns = lines.where(F.col("role").isin(*ROLES)).groupBy("conv_id", "turn", "role").agg(F.count("*").alias("n"))
    inner = {r["role"]: (r["turns"], r["lines"]) for r in turns.groupBy("role").agg(F.count("*").alias("turns"), F.sum("n").alias("lines")).collect()}
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    pairs = turns.join(after, ["conv_id", "turn"]).groupBy("role", "next").count().collect()
    first = {r["role"]: r["count"] for r in turns.where("turn = 0").groupBy("role").count().collect()}
    follow = np.full((len(ROLES), len(ROLES)), 0.5)
    for r in pairs:
        follow[ROLES.index(r["role"]), ROLES.index(r["next"])] += r["count"]
    follow /= follow.sum(1, keepdims=True)
    move, start = np.full((len(STATES), len(STATES)), 1e-12), np.full(len(STATES), 1e-12)
    for i, (role, _) in enumerate(STATES):
        n_turns, n_lines = inner.get(role, (0, 0))
        ends = (n_turns + 1) / (n_lines + 2)
        for j, (other, begins) in enumerate(STATES):
            if begins:
                move[i, j] = ends * follow[ROLES.index(role), ROLES.index(other)]
            elif other == role:
                move[i, j] = 1 - ends
    for role in ROLES:
        start[STATES.index((role, True))] = first.get(role, 0) + 1
    return Model(np.log(start / start.sum()), np.log(move), names, tuple(np.log(e / e.sum(1, keepdims=True)) for e in emit))


def product(model: Model, emissions: np.ndarray, first: bool) -> np.ndarray:
    """Best score from each state before the lines to each state at the last; before the first
    segment there is no state, so every row is the start's."""
    best = None
    for e in emissions:
        step = (np.broadcast_to(model.start, model.move.shape) if first and best is None else model.move) + e
        best = step if best is None else (best[:, :, None] + step[None]).max(1)
    return best


def decode(model: Model, emissions: np.ndarray, before: int, last: int) -> list[int]:
    """The best path that follows state `before` (-1: none) and ends in state `last`."""
    score, back = (model.start if before < 0 else model.move[before]) + emissions[0], []
    for e in emissions[1:]:
        way = score[:, None] + model.move
        back.append(way.argmax(0))
        score = way.max(0) + e
    path = [last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def parse_transcripts(lines: DataFrame, model: Model) -> DataFrame:
    """Recover roles and render turns.

    lines: conv_id (long), line_no (long, from 0 on in each conversation) and line. Gives per
    recovered turn conv_id, at_line (where it begins), role, n_lines, marker (what its first line
    began with, empty if nothing), text (all its lines, without the marker) and rendered, the
    canonical form `<|role|>`, text, `<|end|>`, a line each. Marker and text are all of the turn,
    whatever the segments; a turn is one row, however long. A null line is empty; a null line_no counts as 0; a null conv_id is a
    conversation; lines that repeat stay, in any order among them; other columns are ignored; an
    empty table gives none. A task holds some segments of SEGMENT lines.
    """
    lines = lines.select("conv_id", F.coalesce("line_no", F.lit(0)).alias("line_no"), F.coalesce("line", F.lit("")).alias("line"))
    lines = lines.withColumn("segment", F.floor(F.col("line_no") / SEGMENT)).withColumn("bucket", F.pmod(F.xxhash64("conv_id", "segment"), F.lit(spread(lines.sparkSession, lines, 16))))
    first = lines.groupBy("conv_id").agg(F.min("segment").alias("first"))
    lines = lines.join(first.withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")
    lines = stage(lines, "lines")

    def segments(pdf: pd.DataFrame):
        pdf = pdf.sort_values(["conv_id", "segment", "line_no"], kind="stable")
        return pdf.groupby(["conv_id", "segment"], dropna=False, sort=False)

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(c, s, product(model, model.emissions(g["line"].tolist()), s == g["first"].iloc[0]).ravel()) for (c, s), g in segments(pdf)]
        return pd.DataFrame(out, columns=["conv_id", "segment", "score"]).astype({"conv_id": "Int64"})

    def seams(pdf: pd.DataFrame) -> pd.DataFrame:
        n, out = len(STATES), []
        for conv, g in pdf.sort_values(["conv_id", "segment"]).groupby("conv_id", dropna=False, sort=False):
            squares = [np.asarray(v).reshape(n, n) for v in g["score"]]
            score, back = squares[0][0], []
            for m in squares[1:]:
                way = score[:, None] + m
                back.append(way.argmax(0))
                score = way.max(0)
            path = [int(score.argmax())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            path = path[::-1]
            out += [(conv, s, before, last) for s, before, last in zip(g["segment"], [-1, *path[:-1]], path)]
        return pd.DataFrame(out, columns=["conv_id", "segment", "before", "last"]).astype({"conv_id": "Int64"})

    def pieces(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (conv, segment), g in segments(pdf):
            text = g["line"].tolist()
            path = decode(model, model.emissions(text), int(g["before"].iloc[0]), int(g["last"].iloc[0]))
            begins = [k for k, s in enumerate(path) if STATES[s][1] or not k]
            for a, b in zip(begins, [*begins[1:], len(path)]):
                role, new = STATES[path[a]]
                rest = split_marker(text[a])[1] if new else text[a]
                marker = text[a][: len(text[a]) - len(rest)]
                out.append((conv, segment, g["line_no"].iloc[a], role, new, not new or b == len(path), b - a, marker, "\n".join([rest, *text[a + 1 : b]])))
        return pd.DataFrame(out, columns=["conv_id", "segment", "at_line", "role", "begins", "at_seam", "n_lines", "marker", "text"]).astype({"conv_id": "Int64"})

    scores = lines.groupBy("bucket").applyInPandas(measure, "conv_id long, segment long, score array<double>")
    n = spread(lines.sparkSession, lines, 16)
    ends = scores.groupBy(F.pmod(F.xxhash64("conv_id"), F.lit(n))).applyInPandas(seams, "conv_id long, segment long, before int, last int")
    ends = ends.withColumnsRenamed({"conv_id": "id", "segment": "part"})
    known = lines.join(ends, F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("segment") == F.col("part"))).drop("id", "part")
    cut = stage(known.groupBy("bucket").applyInPandas(pieces, "conv_id long, segment long, at_line long, role string, begins boolean, at_seam boolean, n_lines long, marker string, text string"), "pieces")
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    opened = cut.groupBy("conv_id", "segment").agg(F.max(F.when(F.col("begins"), F.col("at_line"))).alias("opened"))
    opened = opened.select(F.col("conv_id").alias("id"), F.col("segment").alias("part"), F.last("opened", ignorenulls=True).over(before).alias("opened"))  # a row a segment
    seam = cut.where("at_seam").join(opened, F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("segment") == F.col("part")))
    start = F.when(F.col("begins"), F.col("at_line")).otherwise(F.coalesce("opened", "at_line"))
    parts = F.array_sort(F.collect_list(F.struct("segment", "at_line", "role", "marker", "text")))  # one turn's text
    whole = seam.groupBy("conv_id", start.alias("start")).agg(F.sum("n_lines").alias("n_lines"), parts.alias("parts"))
    first = F.col("parts")[0]
    whole = whole.select("conv_id", F.col("start").alias("at_line"), first["role"].alias("role"), "n_lines", first["marker"].alias("marker"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    out = cut.where("not at_seam").select("conv_id", "at_line", "role", "n_lines", "marker", "text").unionByName(whole)
    return out.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n")))


#: Markers that transcripts put before a turn, by role; the k-th of each is one style, the
#: last one is for transcripts that nothing is learned from.
STYLES = {
    "system": ("System: ", "System prompt: ", "Note: ", "<system> ", "### Context: "),
    "user": ("User: ", "Human: ", "Q: ", "<user> ", "### Instruction: "),
    "assistant": ("Assistant: ", "AI: ", "A: ", "<assistant> ", "### Response: "),
}
_UNMARKED = len(STYLES["user"])


def transcript_lines(conversations: DataFrame, learned: Column, part: int = 1024) -> DataFrame:
    """Raw transcripts of the conversations, numbered line by line, with the truth beside each line.

    Each conversation writes its turns in a style of its own, one turn in four lacks its marker.
    Those that are not `learned` from also come in a style that those never have, or without any
    marker. Line numbers are sums of the turns' lines, first over `part` turns, then over parts.
    """
    styles = F.when(learned, _UNMARKED - 1).otherwise(_UNMARKED + 1)
    style = F.pmod(F.xxhash64("conv_id"), styles).cast("int")
    marked = F.coalesce(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) != 0, F.lit(True))
    marker = F.lit("")
    for role in ROLES:
        marker = F.when(F.col("role") == role, F.get(F.array(*map(F.lit, (*STYLES[role], ""))), style)).otherwise(marker)
    text = F.concat(F.when(marked, marker).otherwise(""), F.coalesce("text", F.lit("")))
    turns = conversations.select("conv_id", "turn", "role", learned.alias("learned"), style.alias("style"), F.split(text, "\n").alias("lines"), F.floor(F.coalesce("turn", F.lit(-1)) / part).alias("part"))
    inner = Window.partitionBy("conv_id", "part")
    turns = turns.withColumn("before", F.sum(F.size("lines")).over(inner.orderBy("turn", "role", "lines").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.size("lines"))
    sums = turns.groupBy("conv_id", "part").agg(F.sum(F.size("lines")).alias("n"))
    sums = sums.select(F.col("conv_id").alias("id"), F.col("part").alias("p"), (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("parts"))
    turns = turns.join(sums, F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("part") == F.col("p")))
    lines = turns.select("conv_id", "turn", "role", "learned", "style", (F.col("parts") + F.col("before")).alias("at"), F.posexplode("lines").alias("turn_line", "line"))
    return lines.withColumn("line_no", F.col("at") + F.col("turn_line")).drop("at")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 != 2, F.lit(True))
    lines = stage(transcript_lines(table(spark, sf_dir, "conversations"), learned), "transcripts")
    parsed = parse_transcripts(lines, learn(lines.where("learned")))
    return parsed.drop("text").withColumn("rendered_sha256", F.sha2(F.col("rendered").cast("binary"), 256)).drop("rendered")
