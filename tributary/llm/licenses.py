"""License scans by template-markup matching (operator 7)."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tributary.llm.license_texts import TEMPLATES
from tributary.llm.names import chunks
from tributary.llm.shared import documents

#: Phrases and their labels (fixed by the contract).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_IN_WORD = np.array([b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
#: Most words of the run that a template is looked for by.
ANCHOR = 12


@dataclass
class Automaton:
    """Of a template: per state the wanted words and, for each, the state after it.

    A state may also go on without a word (`skips`) and stay in a replaceable region (`any_word`).
    """

    words: list[dict[str, int]]
    any_word: list[int | None]
    skips: list[list[int]]
    accepts: int

    def reach(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def accepted(self, tokens: list, at: int) -> int | None:
        """The end of the longest accepted run of tokens that starts at `at`."""
        now, end = self.reach({0}), None
        while True:
            if self.accepts in now:
                end = at
            if not now or at >= len(tokens):
                return end
            token = tokens[at]
            now = self.reach({self.words[s][token] for s in now if token in self.words[s]} | {self.any_word[s] for s in now if self.any_word[s] is not None})
            at += 1


def markup_parts(markup: str) -> list[str]:
    """[[, ]], replaceable regions and lower-cased words, in order."""
    return re.findall(r"\[\[|\]\]|<<\w+:\d+-\d+>>|[^\W_]+", markup.lower())


def compile_template(markup: str) -> Automaton:
    """Markup to automaton; optional regions don't nest. Words are bytes, as texts are read."""
    words, any_word, skips = [{}], [None], [[]]

    def state() -> int:
        words.append({})
        any_word.append(None)
        skips.append([])
        return len(words) - 1

    last, opened = 0, None
    for part in markup_parts(markup):
        if part == "[[":
            opened = last
        elif part == "]]":
            skips[opened].append(last)
        elif part.startswith("<<"):
            least, most = map(int, re.findall(r"\d+", part.split(":")[1]))
            begun = []
            for k in range(most):
                if k >= least:
                    begun.append(last)
                after = state()
                any_word[last] = after
                last = after
            for s in begun:
                skips[s].append(last)
        else:
            after = state()
            words[last][part.encode()] = after
            last = after
    return Automaton(words, any_word, skips, last)


def anchored(markup: str) -> tuple[bytes, int, int]:
    """The longest run of mandatory words (ANCHOR at most), by which a template is looked for, and the
    least and the greatest number of words that may stand before it."""
    least = most = 0  # words before the part at hand
    run, run_at, best = [], (0, 0), ([], (0, 0))
    optional = 0
    for part in [*markup_parts(markup), "[["]:
        if part in ("[[", "]]") or part.startswith("<<"):
            if len(" ".join(run[:ANCHOR])) > len(" ".join(best[0])):
                best = run[:ANCHOR], run_at
            run = []
            if part.startswith("<<"):
                low, high = map(int, re.findall(r"\d+", part.split(":")[1]))
                least, most = least + (0 if optional else low), most + high
            else:
                optional = part == "[["
        elif optional:
            most += 1
        else:
            if not run:
                run_at = least, most
            run.append(part)
            least, most = least + 1, most + 1
    return f" {' '.join(best[0])} ".encode(), *best[1]


class _Spaced:
    """A chunk's texts lower-cased, with one blank between words and a NUL among blanks between texts."""

    def __init__(self, x: np.ndarray, ends: np.ndarray):
        x = np.where(_IN_WORD[x], _LOWER[x], np.uint8(32))
        x = np.insert(x, np.repeat(ends, 3), np.tile(np.array([32, 0, 32], np.uint8), len(ends)))
        x = x[(x != 32) | (np.concatenate([[32], x[:-1]]) != 32)]
        self.text = b" " + x.tobytes()
        inside = np.concatenate([[False], _IN_WORD[x]])
        self.word = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        self.ends = np.flatnonzero(np.concatenate([[False], x == 0]))
        self.first = np.searchsorted(self.word, np.concatenate([[0], self.ends]))  # each text's first word
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])

    def places(self, needle: bytes):
        """(text, its word) of each place where the needle's words, blanks around them, stand."""
        at = self.text.find(needle)
        while at >= 0:
            k = int(np.searchsorted(self.ends, at))
            yield k, int(np.searchsorted(self.word, at + 1) - self.first[k])
            at = self.text.find(needle, at + 1)

    def tokens(self, k: int) -> list[bytes]:
        return self.text[self.starts[k] : self.ends[k]].split()


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Find phrases and licence templates in every whole text.

    A-Z are lower-cased; words are runs of digits, Latin letters and non-ASCII characters. A
    template's label is given where its automaton accepts words that follow one another: all
    mandatory wording exactly, optional regions there or not, replaceable ones of a bounded number
    of words. It is tried only where its longest mandatory run stands, from the starts from which
    that run can be reached.

    Gives per row doc_id, n_words, n_base (places of base phrases), first_word and last_word (least
    and greatest start of one, else null), base_labels, labels (sorted, comma-joined), spans
    (array of label, first and last word of each accepted run; of runs of a template that overlap
    the first, as long as it goes) and score: 1 if a template is accepted, 0.5 if only base phrases
    stand in the text, else 0. Null and empty texts have no words and score 0; repeated rows are
    scanned each; null doc_id stays; other columns are ignored; an empty table gives none. A task
    holds a chunk of 1 MB or one longer text.
    """
    base, templates = base or BASE, templates or TEMPLATES
    phrases = [(f" {' '.join(p.split())} ".encode(), label) for p, label in base.items()]
    compiled = [(label, compile_template(t), *anchored(t)) for label, t in templates]
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))), ("score", pa.float64())])

    def accepted(spaced: _Spaced) -> dict[int, set[tuple[int, int, str]]]:
        """(first, last, label) of the runs that templates accept, by text."""
        found: dict[int, set[tuple[int, int, str]]] = {}
        tokens: dict[int, list[bytes]] = {}
        for label, automaton, anchor, least, most in compiled:
            done = (-1, 0)  # text, and its first word that no run of this template covers yet
            for k, at in spaced.places(anchor):
                own = tokens.get(k) or tokens.setdefault(k, spaced.tokens(k))
                for start in range(max(at - most, done[1] if done[0] == k else 0, 0), at - least + 1):
                    if (end := automaton.accepted(own, start)) is not None:
                        found.setdefault(k, set()).add((start, end - 1, label))
                        done = k, end
                        break
        return found

    def scanned(batches):
        for batch, x, ends in chunks(batches):
            spaced = _Spaced(x, ends)
            places: dict[int, list[tuple[int, str]]] = {}
            for needle, label in phrases:
                for k, at in spaced.places(needle):
                    places.setdefault(k, []).append((at, label))
            runs, out = accepted(spaced), []
            n_words = np.diff(spaced.first).tolist()
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                own, spans = places.get(k, []), sorted(runs.get(k, ()))
                labels = {label for _, label in own}
                at = [p for p, _ in own]
                out.append((doc_id, n_words[k], len(own), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {s[2] for s in spans})), [{"label": t, "first": a, "last": b} for a, b, t in spans], 1.0 if spans else 0.5 if own else 0.0))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(scanned, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, spans array<struct<label:string,first:long,last:long>>, score double")


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).drop("spans")


def _pattern(markup: str) -> str:
    """A template as a regular expression over words that are each followed by one blank."""
    out = []
    for part in markup_parts(markup):
        least_most = ",".join(re.findall(r"\d+", part.split(":")[1])) if part.startswith("<<") else ""
        out.append({"[[": "(?:", "]]": ")?"}.get(part) or (f"(?:[^ ]+ ){{{least_most}}}" if least_most else f"{part} "))
    return " " + "".join(out)


_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLACES = " union all ".join(f"select r, '{label}' as label, i from near where {' and '.join(f'w{k} = {chr(39)}{w}{chr(39)}' for k, w in enumerate(p.split()))}" for p, label in BASE.items())
_HITS = " union ".join(f"select r, '{label}' as label from spaced where regexp_matches(words, '{_pattern(t)}')" for label, t in TEMPLATES)
#: Templates are regular expressions here.
OP7_SQL = f"""with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') as ws from documents),
words as (select r, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as i from d),
near as (select r, i, w as w0, lead(w, 1) over (partition by r order by i) as w1, lead(w, 2) over (partition by r order by i) as w2 from words),
places as ({_PLACES}),
spaced as (select r, concat(' ', array_to_string(ws, ' '), ' ') as words from d where len(ws) > 0),
hits as ({_HITS}),
base as (select r, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from places group by r),
every as (select r, string_agg(distinct label, ',' order by label) as labels from (select r, label from places union select r, label from hits) x group by r)
select d.doc_id, len(ws) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  case when d.r in (select r from hits) then 1.0 when n_base > 0 then 0.5 else 0.0 end::double as score
from d left join base b on b.r = d.r left join every e on e.r = d.r"""
