"""Toxicity by a weighted finite-state pattern grammar (operator 8).

Small transducers read a clause word by word: insult (an entry of the lexicon, stronger after an
intensifier), threat (a harm and its target next to each other, or within a few words if an intent
stands a few words before), target (a person addressed or named), negation (its scope is a few words) and reported speech (to the clause's end).
Their composition reads each word once and says which of them speak at it; an insult then counts
under the context reached: plain, strong, aimed, negated or reported. Clauses are what is scored: a
clause's weight by kind is bounded, so a word said ten times in one clause is one matched clause. A
document's clauses, by kind, and its heaviest one go through a logistic function. The lexicon's
weights and the function's, so the contexts' too, are learned from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.names import give_back
from tributary.llm.shared import documents, stage, table

#: Words that steer the grammar and verbs of harm, and common words by which a text's language is told.
WORDS = {
    "en": {
        "target": "you your yours yourself he she him her them their",
        "negation": "not never no nor neither without isn aren wasn don doesn didn ain",
        "report": "said says say saying called calls quoted quote wrote claimed told",
        "intensifier": "so such very really total totally complete utter absolute fucking damn",
        "intent": "will shall gonna going must should ll",
        "harm": "kill hurt murder beat destroy stab shoot strangle choke punch burn bash",
        "common": "the of and to in is that it for was on with as at by this are be from or an have i we they",
    },
    "fr": {
        "target": "tu toi te vous votre ils elles lui",
        "negation": "pas jamais ni sans aucun",
        "report": "dit disait disent appelé écrit",
        "intensifier": "très vraiment tellement",
        "intent": "vais allons va",
        "harm": "tuer frapper détruire poignarder étrangler brûler cogner",
        "common": "le la les des et est dans que qui une un du de il elle en au pour ce sur avec je nous à",
    },
    "de": {
        "target": "du dich dir dein deine ihr euch sie ihn",
        "negation": "nicht kein keine keinen nie niemals ohne",
        "report": "sagte sagt nannte schrieb meinte",
        "intensifier": "sehr so total völlig wirklich",
        "intent": "werde werden wirst muss",
        "harm": "töten schlagen umbringen zerstören erstechen erwürgen verbrennen",
        "common": "der die das und ist in den von zu mit des auf für im dem nicht ein eine als auch es an ich wir er",
    },
    "es": {
        "target": "usted ustedes vosotros ti ellos ellas él ella te le tu",
        "negation": "no nunca jamás tampoco sin ningún",
        "report": "dijo dice decía llamó escribió",
        "intensifier": "muy tan realmente totalmente",
        "intent": "voy vamos va a debe",
        "harm": "matar golpear destruir apuñalar estrangular quemar",
        "common": "el la los las de y en que es un una por con para del se al lo su yo nosotros como más",
    },
}
STEERING = ("target", "negation", "report", "intensifier", "intent", "harm")
CLASSES = {lang: {w: c for c in reversed(STEERING) for w in own[c].split()} for lang, own in WORDS.items()}
_TELLING = {lang: frozenset(w for words in own.values() for w in words.split()) for lang, own in WORDS.items()}


def language(words: list[str]) -> str:
    """The language of whose own words a text has most, the first of WORDS if none or as many."""
    return max(WORDS, key=lambda lang: sum(w in _TELLING[lang] for w in words))


#: Words after a negation that it still governs.
SCOPE = 3
#: Words after an intent in which a harm is meant by it, and after such a harm in which a target is.
REACH = 3
#: Occurrences in one text that count when the lexicon is learned.
TELLS = 5
#: Most weight of a kind in one clause.
CLAUSE = 8.0
KINDS = ("plain", "strong", "aimed", "negated", "reported", "threat")
FEATURES = (*KINDS, "heaviest_clause", "clauses")
_CLAUSE, _TOKEN = re.compile(r"[.!?;\n]+"), re.compile(r"[^\W_]+")

#: Transducers: state -> word class -> (state, what it says); "other" stands for every class not given,
#: and a state without it stays and says nothing.
Transducer = dict[int, dict[str, tuple[int, str]]]
INSULT: Transducer = {0: {"insult": (0, "insult"), "intensifier": (1, "")}, 1: {"insult": (0, "strong"), "intensifier": (1, ""), "other": (0, "")}}
THREAT: Transducer = {
    0: {"intent": (REACH, ""), "harm": (REACH + 1, "")},
    **{k: {"intent": (REACH, ""), "harm": (2 * REACH, ""), "other": (k - 1, "")} for k in range(1, REACH + 1)},
    **{REACH + k: {"intent": (REACH + k - 1, ""), "harm": (REACH + k, ""), "target": (0, "threat"), "other": (REACH + k - 1 if k > 1 else 0, "")} for k in range(1, REACH + 1)},
}
TARGET: Transducer = {0: {"target": (1, "")}, 1: {"other": (1, "aimed")}}
NEGATION: Transducer = {0: {"negation": (SCOPE, "")}, **{k: {"negation": (SCOPE, "negated"), "other": (k - 1, "negated")} for k in range(1, SCOPE + 1)}}
REPORTED: Transducer = {0: {"report": (1, "")}, 1: {"other": (1, "reported")}}
MACHINES = (INSULT, THREAT, TARGET, NEGATION, REPORTED)


def compose(*machines: Transducer) -> dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], frozenset[str]]]:
    """The product over the word classes, for the states that can be reached: the next state and all
    that the machines say."""
    classes = ("insult", "other", *STEERING)
    moves, todo = {}, [(0,) * len(machines)]
    while todo:
        at = todo.pop()
        for c in classes:
            if (at, c) not in moves:
                steps = [m[s].get(c) or m[s].get("other") or (s, "") for m, s in zip(machines, at)]
                moves[at, c] = tuple(s for s, _ in steps), frozenset(w for _, w in steps if w)
                todo.append(moves[at, c][0])
    return moves


def kind_of(said: frozenset[str]) -> str | None:
    """Under which kind a word counts: negation is stronger than report, report than aim."""
    if not said & {"insult", "strong", "threat"}:
        return None
    for context in ("negated", "reported", "threat", "aimed", "strong"):
        if context in said:
            return context
    return "plain"


@dataclass
class Grammar:
    """insults: weight of a word, or of a beginning of words if it ends in `*`. slopes: of FEATURES."""

    insults: dict[str, float]
    bias: float = 0.0
    slopes: tuple[float, ...] = (1.0,) * len(FEATURES)

    def __post_init__(self):
        composed = compose(*MACHINES)
        number = {at: k for k, at in enumerate(dict.fromkeys(at for at, _ in composed))}
        self.moves = {(number[at], c): (number[to], KINDS.index(kind) if (kind := kind_of(said)) else -1) for (at, c), (to, said) in composed.items()}
        self.words = {w: v for w, v in self.insults.items() if not w.endswith("*")}
        self.stems = {w[:-1]: v for w, v in self.insults.items() if w.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems})
        self.literals = [*self.words, *self.stems, *(w for own in WORDS.values() for w in own["harm"].split())]

    def weight(self, word: str) -> float:
        return max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in self.lengths)])

    def clause(self, words: list[str], lang: str = "en") -> list[float]:
        """Weight by kind of one clause; a threat weighs 1."""
        classes = CLASSES[lang]
        found, at = [0.0] * len(KINDS), 0
        for word in words:
            weight = self.weight(word)
            at, kind = self.moves[at, "insult" if weight else classes.get(word, "other")]
            if kind >= 0:
                found[kind] += weight or 1.0
        return found

    def emitted(self, text: str) -> list[float]:
        """FEATURES of a text: its matched clauses by kind, the heaviest one, and how many match."""
        total, low = [0.0] * len(FEATURES), text.lower()
        if not any(w in low for w in self.literals):
            return total
        clauses = [_TOKEN.findall(clause) for clause in _CLAUSE.split(low)]
        lang = language([w for words in clauses for w in words])
        for words in clauses:
            found = self.clause(words, lang)
            for k, v in enumerate(found):
                total[k] += min(v, CLAUSE)
            total[-2] = max(total[-2], min(sum(found), CLAUSE))
            total[-1] += any(found)
        return total

    def score(self, total: list[float]) -> float:
        z = self.bias + sum(b * v for b, v in zip(self.slopes, total))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _features(text: str) -> Counter[str]:
    """Occurrences of words and of beginnings of 3 to 12 letters of longer ones; of each TELLS at most
    count, so that no text makes an entry of the lexicon alone."""
    seen: Counter[str] = Counter()
    for word, n in Counter(_TOKEN.findall(text.lower())).items():
        for feature in (word, *(f"{word[:k]}*" for k in range(3, min(13, len(word))))):
            seen[feature] += n
    return Counter({f: min(n, TELLS) for f, n in seen.items()})


def _counted(rows: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """How often each feature stands in the texts."""

    def count(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                found = _features(text.as_py() or "")
                seen.update(found if wanted is None else {f: n for f, n in found.items() if f in wanted})
        yield pa.RecordBatch.from_pydict({"feature": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
        seen.clear()
        give_back()

    return rows.select("text").mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, precision: float = 0.6) -> Grammar:
    """Fit the lexicon and the logistic function to labelled documents.

    labels: doc_id, toxic (0 or 1; null rows are left out). About `max_rows` different texts, by
    hashes of doc_id and text, take part (all if there are fewer): the bound on what the driver
    gets. Words and beginnings of words that occur in the different toxic texts as often as 1 % of
    their number (ten times at least) make the lexicon, by `chosen`. Without both kinds of labels
    the grammar scores every text 0.
    """
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    part = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_rows / max(n, 1)))
    labels = labels.where(part(labels.count(), "doc_id"))
    few = F.broadcast(labels) if labels.count() <= 2 * max_rows else labels  # two numbers a row; doc_ids may repeat
    known = stage(docs.select("doc_id", "text").join(few, "doc_id").select("text", "toxic").distinct(), "known")
    known = known.where(part(known.count(), "text"))
    toxic, clean = known.where("toxic = 1"), known.where("toxic = 0")
    size = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        return Grammar({}, bias=-30.0)
    least = max(10, size[1] // 100)
    often = {r["feature"]: r["n"] for r in _counted(toxic, None).where(F.col("n") >= least).collect()}
    also = {r["feature"]: r["n"] for r in _counted(clean, frozenset(often)).collect()}
    odds = lambda f: math.log((often[f] + 0.5) / (also.get(f, 0) + 0.5) * (size[0] + 1) / (size[1] + 1))
    grammar = Grammar({f: odds(f) for f in chosen(often, also, precision, least)})
    rows = emit(known.select(F.lit(None).cast("long").alias("doc_id"), "text", "toxic"), grammar, "toxic").select("toxic", *FEATURES).collect()  # about max_rows
    grammar.bias, *slopes = _logistic(np.array([r[1:] for r in rows]), np.array([r[0] for r in rows], float))
    grammar.slopes = tuple(slopes)
    return grammar


def chosen(toxic: dict[str, int], clean: dict[str, int], precision: float, least: int) -> list[str]:
    """Entries of the lexicon from how often words and beginnings of words occur in the texts.

    An entry gains its occurrences in toxic texts less those in clean ones, these so weighted that `precision` breaks
    even. Of nested ones either the shorter is taken or the best of its extensions, whichever gains
    more; what is taken is made as long as it goes while it keeps 97 % of its occurrences.
    """
    cost = precision / (1 - precision)
    below: dict[str, list[str]] = {}
    for f in toxic:
        stem = f.rstrip("*")
        parent = next((p for k in range(len(stem) - f.endswith("*"), 2, -1) if (p := f"{stem[:k]}*") in toxic), "")
        below.setdefault(parent, []).append(f)
    best: dict[str, tuple[float, list[str]]] = {}
    for f in sorted(toxic, key=lambda f: (len(f.rstrip("*")), not f.endswith("*")), reverse=True):
        own = toxic[f] - cost * clean.get(f, 0) - least
        kept = [best[g] for g in below.get(f, []) if best[g][0] > 0]
        deeper = sum(g for g, _ in kept)
        best[f] = (own, [f]) if own >= deeper else (deeper, [x for _, fs in kept for x in fs])
    taken = [f for root in below.get("", []) if best[root][0] > 0 for f in best[root][1]]

    def longest(f: str) -> str:
        same = next((g for g in below.get(f, []) if toxic[g] >= 0.97 * toxic[f]), None)
        return longest(same) if same else f

    return sorted({longest(f) for f in taken})


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, steps: int = 50) -> list[float]:
    """Newton's method, bias first; the penalty also settles kinds that never occur."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T * (p * (1 - p)) @ x + np.diag(ridge), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta.tolist()


def emit(docs: DataFrame, grammar: Grammar, *keep: str) -> DataFrame:
    """doc_id, the `keep` columns, FEATURES and the score of each text."""
    measures = (*FEATURES, "score")

    def read(batches):
        for batch in batches:
            found = [grammar.emitted(t.as_py() or "") for t in batch.column(1)]
            columns = [pa.array(c, pa.float64()) for c in zip(*[(*f, grammar.score(f)) for f in found])] or [pa.array([], pa.float64())] * len(measures)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, *range(2, batch.num_columns))), *columns], names=["doc_id", *keep, *measures])
        give_back()

    docs = docs.select("doc_id", F.col("text").alias("read_text"), *keep)
    types = dict(docs.dtypes)
    fields = [f"doc_id {types['doc_id']}", *(f"`{c}` {types[c]}" for c in keep), *(f"{m} double" for m in measures)]
    return docs.mapInArrow(read, ", ".join(fields))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **learning) -> DataFrame:
    """Score every whole text by the grammar learned from `labels`.

    Gives per row doc_id, the clauses' weights by kind, heaviest_clause, clauses (how many match), score and predicted (1 from
    `threshold` on). Null and empty texts get the score of a text without any match; repeated rows
    are scored each, alike; null doc_id stays; other columns are ignored; empty documents give
    none; without labels of both kinds all scores are near 0.
    """
    scored = emit(docs, learn(docs, labels, **learning))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = score_toxicity(documents(spark, sf_dir), labels)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
