"""Quality rules in a short-circuit cascade (operator 10).

A rule needs measures (its own counts and what they are made of: the words, the lines, names of
substrings), each computed when a rule first asks for it, and only for documents that no earlier
rule has rejected. A sample tells what each measure costs and which rules reject which documents
together; the order then takes, again and again, the rule with most rejections of documents still
there per second that it still adds.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.exchange import run_lengths, run_starts
from tributary.llm.names import Named, chunks, words_of
from tributary.llm.shared import documents

#: Fixed by the contract.
SYMBOLS = b"#*$%&|<>"
#: The texts at hand are copied together anew when they have become so many times fewer.
SHRINK = 1.25


def _flags(chars: bytes) -> np.ndarray:
    known = np.zeros(256, bool)
    known[list(chars)] = True
    return known


_SYMBOL, _UPPER, _LOWER = _flags(SYMBOLS), _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123)))


@dataclass
class Texts:
    """Some documents' bytes and what rules measure on them, each computed when first asked for."""

    x: np.ndarray
    ends: np.ndarray

    def per_document(self, hit: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(hit)])
        return np.diff(total[np.concatenate([[0], self.ends])])

    @cached_property
    def words(self):
        return words_of(self.x, self.ends)

    @cached_property
    def named(self) -> Named:
        return Named(self.x)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.bincount(self.words[2], minlength=len(self.ends))

    @cached_property
    def word_chars(self) -> np.ndarray:
        blank = (self.x == 32) | ((self.x >= 9) & (self.x <= 13))
        return self.per_document(~blank & ((self.x & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.per_document(_SYMBOL[self.x])

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of the lines that hold a word."""
        first = np.zeros(len(self.x) + 1, bool)
        first[1:] = np.append(self.x == 10, True)[:-1]
        first[np.concatenate([[0], self.ends[:-1]])] = True
        start = np.flatnonzero(first[:-1])
        end = np.append(start[1:], len(self.x))
        end = end - (self.x[end - 1] == 10) if len(start) else end
        seen = np.searchsorted(self.words[0], [start, end])
        held = seen[1] > seen[0]
        return start[held], end[held], np.searchsorted(self.ends, start[held], "right")

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[2], minlength=len(self.ends))

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        start, end, doc = self.lines
        name = self.named.of(start, end)
        order = np.lexsort((name, doc))
        new = np.bincount(doc[order][run_starts(name[order], doc[order])], minlength=len(self.ends))
        return self.n_lines - new

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        start, end, doc = self.words
        windows = Named(self.named.of(start, end)).every(5)
        at = np.flatnonzero(doc[: len(windows)] == doc[4 : 4 + len(windows)]) if len(windows) else np.zeros(0, np.int64)
        order = np.lexsort((windows[at], doc[at]))
        first = run_starts(windows[at][order], doc[at][order])
        count = run_lengths(first, len(at))
        hit = at[order[np.repeat(count > 1, count)]]
        edge = np.zeros(len(doc) + 1, np.int64)
        edge[hit] += 1
        edge -= np.bincount(hit + 5, minlength=len(edge))[: len(edge)]
        return np.bincount(doc[np.cumsum(edge)[:-1] > 0], minlength=len(self.ends))

    @cached_property
    def longest_word(self) -> np.ndarray:
        longest = np.zeros(len(self.ends), np.int64)
        np.maximum.at(longest, self.words[2], self.words[1] - self.words[0])
        return longest

    def subset(self, alive: np.ndarray) -> Texts:
        starts = np.concatenate([[0], self.ends[:-1]])
        size = (self.ends - starts)[alive]
        mask = np.repeat(alive, self.ends - starts)
        return Texts(self.x[mask], np.cumsum(size))


@dataclass(frozen=True)
class Rule:
    """Which documents are rejected, and the measures that this needs, each after those it is made of."""

    rejects: Callable[[Texts], np.ndarray]
    needs: tuple[str, ...] = ()


_WORDS, _LINES = ("words", "n_words"), ("words", "lines", "n_lines")
BASE_RULES: dict[str, Rule] = {
    "few_words": Rule(lambda t: t.n_words < 10, _WORDS),
    "repeated_windows": Rule(lambda t: 100 * t.n_repeat_words > 20 * t.n_words, (*_WORDS, "named", "n_repeat_words")),
}
#: Bounds wide enough that prose, tables and lists of any language pass.
RULES: dict[str, Rule] = BASE_RULES | {
    "symbols": Rule(lambda t: t.n_symbols > 2 * t.n_words, (*_WORDS, "n_symbols")),
    "repeated_lines": Rule(lambda t: (t.n_lines >= 5) & (2 * t.n_dup_lines > t.n_lines), (*_LINES, "named", "n_dup_lines")),
    "word_length": Rule(lambda t: (t.word_chars > 25 * t.n_words) | (2 * t.word_chars < 3 * t.n_words), (*_WORDS, "word_chars")),
    "shouting": Rule(lambda t: 10 * t.per_document(_UPPER[t.x]) > 9 * (t.per_document(_UPPER[t.x] | _LOWER[t.x]) + 1)),
    "endless_word": Rule(lambda t: t.longest_word > 1000, ("words", "longest_word")),
}


def measure(docs: DataFrame, rules: dict[str, Rule], sample_rows: int) -> list[tuple]:
    """(what, key, value) summed over a random sample of about `sample_rows` documents: seconds of each
    measure, seconds of each rule once its measures are there, and how many documents each set of
    rules (as bits) rejects. The sample is drawn where the rows are; it is all that moves."""
    names = list(rules)

    def tried(batches):
        for _, x, ends in chunks(batches):
            texts, found, masks = Texts(x, ends), [], np.zeros(len(ends), np.int64)
            for k, name in enumerate(names):
                for need in rules[name].needs:
                    if need not in texts.__dict__:
                        began = time.perf_counter()
                        getattr(texts, need)
                        found.append(("measure", need, time.perf_counter() - began))
                began = time.perf_counter()
                masks |= rules[name].rejects(texts).astype(np.int64) << k
                found.append(("rule", name, time.perf_counter() - began))
            found += [("together", str(m), float(n)) for m, n in zip(*np.unique(masks, return_counts=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["what", "key", "value"])

    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = docs.where(F.rand(10) < share).repartition(4)  # whole texts, but a bounded number of them
    seen = sample.mapInArrow(tried, "what string, key string, value double").groupBy("what", "key").agg(F.sum("value").alias("value"))
    return [tuple(r) for r in seen.collect()]  # a row for each measure, rule and set of rules that occurs


def ordered(rules: dict[str, Rule], seen: list[tuple]) -> list[str]:
    """Rules by rejections per added second: a measure that an earlier rule has asked for is free."""
    cost = {(what, key): value for what, key, value in seen}
    together = {int(key): value for what, key, value in seen if what == "together"}
    names, left, there = list(rules), list(rules), set()
    order: list[str] = []
    while left:

        def gain(name: str) -> float:
            seconds = cost.get(("rule", name), 0.0) + sum(cost.get(("measure", m), 0.0) for m in rules[name].needs if m not in there)
            gone = sum(1 << names.index(o) for o in order)
            return sum(n for mask, n in together.items() if mask >> names.index(name) & 1 and not mask & gone) / max(seconds, 1e-9)

        best = max(left, key=gain)
        order.append(best)
        left.remove(best)
        there |= set(rules[best].needs)
    return order


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def cascade(texts: Texts, rules: dict[str, Rule], order: list[str], counts: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Kept or not, the rejecting rule, and the wanted counts of each document.

    The documents that rules still look at shrink with every rejection of note; what is measured on
    them is kept for the counts, which the rejected ones get after the verdict.
    """
    n = len(texts.ends)
    alive, by = np.ones(n, bool), np.full(n, None, object)
    at, held = np.arange(n), texts  # the documents that rules look at
    measured = [np.zeros(n, np.int64) for _ in counts]

    def count(where: np.ndarray, own: Texts) -> None:
        for into, c in zip(measured, counts):
            into[where] = getattr(own, c)

    for name in order:
        bad = at[rules[name].rejects(held) & alive[at]]
        by[bad] = name
        alive[bad] = False
        stay = alive[at]
        if not stay.any():
            break
        if SHRINK * stay.sum() < len(at):
            lost = held.subset(~stay)
            count(at[~stay], lost)
            at, held = at[stay], held.subset(stay)
    count(at, held)
    return alive, by, measured


def quality_cascade(docs: DataFrame, rules: dict[str, Rule] | None = None, counts: bool = True, sample_rows: int = 2000) -> DataFrame:
    """Judge every whole text by rules, stopping at the first that rejects it.

    The order of the rules is that of rejections per second on a random sample of about
    `sample_rows` texts; it changes the work done, never the verdict (a document is kept if no rule
    rejects it). A rule runs on the documents of a chunk that no earlier rule has rejected.

    Gives the columns of `docs`' doc_id, then kept and rejected_by (of the order used; null if
    kept) and, with `counts`, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of
    every document. Null text counts as empty (0 words: rejected by few_words); repeated rows are
    judged each; null doc_id stays; other columns are ignored; an empty table gives none. A task
    holds a chunk of 1 MB of text or one longer document.
    """
    rules = rules or RULES
    docs = docs.select("doc_id", "text")
    order = ordered(rules, measure(docs, rules, sample_rows))
    wanted = _COUNTS if counts else ()
    fields = [("doc_id", pa.int64()), ("kept", pa.bool_()), ("rejected_by", pa.string())] + [(c, pa.int64()) for c in wanted]
    schema = pa.schema(fields)

    def judged(batches):
        for batch, x, ends in chunks(batches):
            alive, by, measured = cascade(Texts(x, ends), rules, order, wanted)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(alive), pa.array(by, pa.string()), *map(pa.array, measured)], schema=schema)

    types = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string"}
    return docs.mapInArrow(judged, ", ".join(f"{n} {types[t]}" for n, t in fields))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_cascade(documents(spark, sf_dir))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select("doc_id", *_COUNTS, failed.alias("base_failed"), "kept")


_W = r"[^\x20\x09-\x0D]+"
#: The rules in SQL: RULES, base rules included.
OP10_SQL = rf"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
words as (select r, unnest(regexp_extract_all(text, '{_W}')) as w, generate_subscripts(regexp_extract_all(text, '{_W}'), 1) as i from d),
windows as (select r, i, string_agg(w, ' ') over (partition by r order by i rows between current row and 4 following) as five,
  count(*) over (partition by r order by i rows between current row and 4 following) as n from words),
again as (select r, i from (select r, i, count(*) over (partition by r, five) as k from windows where n = 5) x where k > 1),
covered as (select r, count(distinct j) as n_repeat_words from (select r, i + unnest(range(5)) as j from again) x group by r),
counted as (select r, count(*) as n_words, cast(sum(length(w)) as bigint) as word_chars, max(octet_length(encode(w))) as longest from words group by r),
lines as (select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select r, unnest(string_split(text, chr(10))) as line from d) x where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
joined as (select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, coalesce(longest, 0) as longest,
  len(regexp_extract_all(text, '[A-Z]')) as upper, len(regexp_extract_all(text, '[A-Za-z]')) as letters
  from d left join counted using (r) left join covered using (r) left join lines using (r)),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from joined)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or n_symbols > 2 * n_words or (n_lines >= 5 and 2 * n_dup_lines > n_lines) or word_chars > 25 * n_words or 2 * word_chars < 3 * n_words
    or 10 * upper > 9 * (letters + 1) or longest > 1000) as kept from judged"""
