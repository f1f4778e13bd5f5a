"""Substring dedup by prefix-partitioned suffix trees (operator 6), over words.

1. Sampling. Synchronised word positions (least name of `gram` words among the starts that fit a
   window) lie at equal offsets in equal windows, the least gram of a window always among them.
   Where no other document has it as a sample, the suffix cannot be repeated and is in no tree.
2. Prefix partition. Every window is placed by its least gram, and with it the suffixes from there on:
   equal windows have equal least grams at equal offsets. Counts of shared samples cut the grams into
   groups of about one size; a gram that is too frequent for a group is split by longer prefixes, up
   to the whole window. A group's suffixes, as the words they begin with, go to one task.
3. Subtrees. A group's suffixes are sorted word by word; the words that neighbours share (the LCP
   array) make the internal nodes, and those of depth `window` or more are the repeats. All leaves of
   such a node but those of its smallest document are removed. Words are compared, not their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.exchange import BINS, NAME, SENT, Groups, bin_counts, bits_back, bits_of, by_name, distinct, exchange, kept_row, least_bytes, numbered, rows, run_starts, sent_rows
from tributary.llm.names import Named, chunks, packed, slid, synchronised, words_of
from tributary.llm.shared import BROADCAST_ROWS, documents, matched, spread, stage, text_key

GRAM = 4


class _Words:
    """A chunk's words, where each document's begin, and names of word ranges."""

    def __init__(self, x: np.ndarray, ends: np.ndarray):
        self.x = x
        self.start, self.end, self.doc = words_of(x, ends)
        self.first = np.searchsorted(self.doc, np.arange(len(ends) + 1))
        self.word = Named(x).of(self.start, self.end)
        self.named = Named(self.word)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and names of the word ranges of a length that lie in one document."""
        names = self.named.every(length)
        at = np.flatnonzero(self.doc[: len(names)] == self.doc[length - 1 : length - 1 + len(names)])
        return at, names[at]


def _samples(buckets: int, window: int, gram: int):
    """Sends a sample's name once if several documents of the chunk hold it (which settles it
    there), else at each place; a bucket's names stand in the order of places."""

    def map_chunks(batches):
        number = numbered()
        for batch, x, ends in chunks(batches):
            chunk, words = next(number), _Words(x, ends)
            every = words.named.every(gram)
            at = synchronised((every >> np.uint64(32)).astype(np.uint32), window - gram + 1)
            at = at[words.doc[at] == words.doc[at + gram - 1]]
            name, doc = every[at], words.doc[at]
            order = np.argsort(name, kind="stable")
            first = run_starts(name[order])
            several = np.zeros(len(at), bool)
            run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
            several[order] = (doc[order][np.append(first[1:], len(at)) - 1] != doc[order][first])[run] if len(at) else False
            sends = ~several
            sends[order[first]] = True
            bucket = by_name(name, buckets)
            sent = np.flatnonzero(sends)
            sent = sent[np.argsort(bucket[sent], kind="stable")]
            bins = (name % np.uint64(BINS)).astype(np.uint16)
            kept = kept_row(buckets, chunk, (_ids(batch), words.first, np.packbits(several), np.packbits(sends), least_bytes(bucket), least_bytes(np.diff(at, prepend=0)), bins))
            yield rows([*sent_rows(chunk, name[sent], bucket[sent]), kept])

    return map_chunks


def _ids(batch: pa.RecordBatch) -> tuple[list, np.ndarray]:
    return batch.column("doc_id").to_pylist(), batch.column("key").to_numpy()


def _shared(names: np.ndarray, cuts: np.ndarray) -> list[bytes | None]:
    """Names that more than one chunk sent."""
    part = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    order = np.lexsort((part, names))
    first = run_starts(names[order])
    last = np.append(first[1:], len(names)) - 1
    flag = np.zeros(len(names), bool)
    flag[order] = np.repeat(part[order][last] != part[order][first], last - first + 1)
    return bits_back(flag, cuts)


def _tied(kept, back) -> pd.DataFrame:
    """Places of the samples that another document has as well, by document."""
    (ids, keys), first, several, sends, bucket, steps, bins = kept
    n = len(steps)
    tied, sends = np.unpackbits(several, count=n).astype(bool), np.unpackbits(sends, count=n).astype(bool)
    sent = np.flatnonzero(sends)
    sent = sent[np.argsort(bucket[sent], kind="stable")]
    tied[sent] |= bits_of(back, bucket[sent])
    at, bins = np.cumsum(steps.astype(np.int64))[tied], bins[tied]
    doc = np.searchsorted(first, at, "right") - 1
    cut = run_starts(doc) if len(doc) else []
    found = [(ids[doc[a]], keys[doc[a]], packed(at[a:b] - first[doc[a]], "<u4"), packed(bins[a:b], "<u2")) for a, b in zip(cut, [*cut[1:], len(doc)])]
    return pd.DataFrame(found, columns=["doc_id", "key", "near", "bins"]).astype({"doc_id": "Int64"})


def _near(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(v.as_py(), "<u4").astype(np.int64) for v in batch.column("near")]


class _Text:
    """A chunk's words joined by one blank."""

    def __init__(self, words: _Words):
        size = words.end - words.start
        self.at = np.concatenate([[0], np.cumsum(size + 1)])
        own = np.arange(self.at[-1]) - np.repeat(self.at[:-1] - words.start, size + 1)
        self.x = np.append(words.x, np.uint8(32))[own]
        self.x[self.at[1:] - 1] = 32

    def lines(self, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The words lo to hi, a line for each, and where each line ends."""
        start, size = self.at[lo], self.at[hi] - self.at[lo]
        ends = np.cumsum(size)
        x = self.x[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]
        x[ends - 1] = 10
        return x.tobytes(), ends


def _leaves(lowest: int, groups: Groups, window: int, gram: int):
    """Sends the suffixes of a chunk's least document at each label; those of later ones are repeats
    already. Suffixes that follow one another and are in one group are one line of words. A group's
    suffixes stand in the order of places; a line that holds k of them has window + k - 1 words."""

    def map_chunks(batches):
        number = numbered()
        for batch, x, ends in chunks(batches):
            words, ids = _Words(x, ends), _ids(batch)
            every = words.named.every(gram)
            tied = np.zeros(len(words.doc), bool)
            tied[np.concatenate([near + f for near, f, i in zip(_near(batch), words.first, ids[0]) if i is not None] or [[]]).astype(np.int64)] = True
            at = words.windows(window)[0]
            order = (every >> np.uint64(32)) << np.uint64(31) | np.arange(len(every), dtype=np.uint64)
            lead = (slid(order, window - gram + 1, np.minimum) & np.uint64((1 << 31) - 1)).astype(np.int64) if len(at) else at
            at = at[tied[lead[at]]]
            own = np.array([0 if i is None else i for i in ids[0]], np.int64)[words.doc[at]]
            label = words.named.of(at, at + window)
            names, which, _ = distinct(label)
            least = np.full(len(names), np.iinfo(np.int64).max)
            np.minimum.at(least, which, own)
            later = own > least[which]
            bucket = groups.of(every[lead[at]], label)
            sent = np.flatnonzero(~later)
            sent = sent[np.argsort(bucket[sent], kind="stable")]
            a, g, d = at[sent], bucket[sent], own[sent]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1] + 1) | (g[1:] != g[:-1]) | (words.doc[a[1:]] != words.doc[a[:-1]])
            line = np.flatnonzero(new)
            text, stops = _Text(words).lines(a[line], np.append(a[line[1:] - 1], a[-1:]) + window)
            chunk, doc, out = next(number), d[line] - lowest, []
            turn = np.concatenate([[0], np.flatnonzero(np.diff(g[line])) + 1, [len(line)]]) if len(line) else np.zeros(1, np.int64)
            for lo, hi in zip(turn[:-1], turn[1:]):
                held = int(hi - lo).to_bytes(4, "little") + packed(doc[lo:hi], "<u8") + text[stops[lo - 1] if lo else 0 : stops[hi - 1]]
                out.append((int(g[line[lo]]), chunk, held, None))
            kept = kept_row(groups.buckets, chunk, (ids, words.first, least_bytes(np.diff(at, prepend=0)), np.packbits(later), least_bytes(bucket)))
            yield rows([*out, kept])

    return map_chunks


class Subtree:
    """The suffixes of a group, sorted by their first `depth` words, and the nodes that deep."""

    def __init__(self, lines: list[bytes], docs: np.ndarray, depth: int):
        parts = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        self.words, n = parts.flatten(), np.diff(parts.offsets.to_numpy())
        coded = self.words.dictionary_encode()
        rank = np.empty(len(coded.dictionary), np.uint64)
        rank[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank), dtype=np.uint64)
        code = rank[coded.indices.to_numpy()]
        self.each = n - depth + 1  # suffixes of each line
        line = np.repeat(np.arange(len(n)), self.each)
        first = np.cumsum(n) - n
        self.start = first[line] + np.arange(len(line)) - (np.cumsum(self.each) - self.each)[line]
        self.doc = docs[line]
        pairs = [code[self.start + k] << np.uint64(32) | (code[self.start + k + 1] if k + 1 < depth else np.uint64(0)) for k in range(0, depth, 2)]
        self.order = np.lexsort((self.doc, *reversed(pairs)))
        at = self.start[self.order]
        same, self.lcp = np.ones(max(len(at) - 1, 0), bool), np.zeros(len(at), np.int64)
        for k in range(depth):  # words that each suffix shares with the one before it
            same &= code[at[1:] + k] == code[at[:-1] + k]
            self.lcp[1:] += same
        self.node = np.cumsum(self.lcp < depth) - 1  # the deep node, or lone leaf, of each in order
        self.least = self.doc[self.order][np.flatnonzero(self.lcp < depth)]  # within a node documents are in order

    def later(self) -> np.ndarray:
        """Suffixes whose node a smaller document is in as well, as they came."""
        out = np.zeros(len(self.order), bool)
        out[self.order] = self.doc[self.order] > self.least[self.node]
        return out


def _opened(parts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The lines and documents of a group, and how many lines each sender has."""
    size = np.array([int.from_bytes(x[:4], "little") for x in parts])
    docs = np.concatenate([np.frombuffer(x, "<u8", n, 4) for x, n in zip(parts, size)])
    return b"".join(x[4 + 8 * n :] for x, n in zip(parts, size)).split(b"\n")[:-1], docs, size


def _later(window: int):
    def answer(parts: list[bytes]) -> list[bytes | None]:
        lines, docs, size = _opened(parts)
        tree = Subtree(lines, docs, window)
        cuts = np.concatenate([[0], np.cumsum(tree.each)])[np.concatenate([[0], np.cumsum(size)])]
        return bits_back(tree.later(), cuts)

    return answer


def _spans(window: int):
    def finish(kept, back) -> pd.DataFrame:
        (ids, keys), first, steps, later, bucket = kept
        at = np.cumsum(steps.astype(np.int64))
        repeat = np.unpackbits(later, count=len(at)).astype(bool)
        sent = np.flatnonzero(~repeat)
        sent = sent[np.argsort(bucket[sent], kind="stable")]
        repeat[sent] = bits_of(back, bucket[sent])
        at, out = at[repeat], []
        edge = np.bincount(at, minlength=first[-1] + 1) - np.bincount(at + window, minlength=first[-1] + 1)
        gone = np.cumsum(edge)[:-1] > 0
        for k in range(len(ids)):
            g = gone[first[k] : first[k + 1]]
            if g.any():
                turn = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
                out.append((ids[k], keys[k], turn[::2].tolist(), turn[1::2].tolist()))
        return pd.DataFrame(out, columns=["doc_id", "key", "span_starts", "span_ends"]).astype({"doc_id": "Int64"})

    return finish


def _without_spans(batches):
    for batch, x, ends in chunks(batches):
        words, text = _Words(x, ends), x.tobytes()
        n_words, kept = np.diff(words.first), []
        for k, (starts, stops) in enumerate(zip(batch.column("span_starts").to_pylist(), batch.column("span_ends").to_pylist())):
            at = [0, *(t for span in zip(starts, stops) for t in span), int(n_words[k])]
            left = [i + words.first[k] for a, b in zip(at[::2], at[1::2]) for i in range(a, b)]
            kept.append(b" ".join(text[words.start[i] : words.end[i]] for i in left).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("key"), pa.array(n_words, pa.int64()), batch.column("span_starts"), batch.column("span_ends"), pa.array(kept, pa.string())], names=["doc_id", "key", "n_words", "span_starts", "span_ends", "kept"])


def _among(docs: DataFrame, keyed: DataFrame, n: int, how: str) -> DataFrame:
    """Rows of docs that are (not) among n keyed ones; the keys, two longs each, are broadcast only
    if they are few."""
    keys = keyed.select("doc_id", "key")
    return matched(docs, F.broadcast(keys) if n <= BROADCAST_ROWS else keys, how)


def substring_dedup(docs: DataFrame, window: int = 13, gram: int = GRAM) -> DataFrame:
    """Remove from every text the words of each `window`-word sequence that also starts in a
    document with a smaller doc_id; windows are judged on the input.

    Words are runs of anything but ASCII white space. Gives one row per input row: doc_id, key,
    n_words, span_starts and span_ends (arrays of the maximal removed runs, in words) and kept
    (the words left, joined by one space). Null text has no words; texts shorter than a window
    keep all; rows with equal doc_id don't remove from each other; a document whose doc_id is null
    neither loses words nor makes others lose any; other columns are ignored; an empty table gives
    none. A task holds one chunk (2 MB of text or one longer document) or one prefix group.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    buckets = spread(docs.sparkSession, docs)
    sent = docs.mapInArrow(_samples(buckets, window, gram), SENT)
    flags = exchange(sent, buckets, NAME, _shared, _tied, "doc_id long, key long, near binary, bins binary")
    flags = stage(flags.dropDuplicates(["doc_id", "key"]), "stretches")
    bounds = flags.agg(F.count("*"), F.min("doc_id")).first()
    tied = matched(_among(docs, flags, bounds[0], "left_semi"), flags.select("doc_id", "key", "near"), "inner", "merge").select("doc_id", "key", "text", "near")
    lowest = bounds[1] or 0
    groups = Groups(bin_counts(flags), buckets)
    spans = exchange(tied.mapInArrow(_leaves(lowest, groups, window, gram), SENT), groups.buckets, None, _later(window), _spans(window), "doc_id long, key long, span_starts array<int>, span_ends array<int>")
    spans = stage(spans.dropDuplicates(["doc_id", "key"]), "repeats")  # repeated rows lose the same words
    n = spans.count()
    cut = matched(_among(docs, spans, n, "left_semi"), spans, "inner", "merge").select("doc_id", "key", "text", "span_starts", "span_ends")
    cut = cut.mapInArrow(_without_spans, "doc_id long, key long, n_words long, span_starts array<int>, span_ends array<int>, kept string")
    free = _among(docs, spans, n, "left_anti")
    none = F.array().cast("array<int>")
    plain = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    free = free.select("doc_id", "key", plain.alias("kept"))
    n_words = F.when(F.col("kept") == "", 0).otherwise(F.octet_length("kept") - F.octet_length(F.replace("kept", F.lit(" "), F.lit(""))) + 1)
    whole = free.select("doc_id", "key", n_words.cast("long").alias("n_words"), none.alias("span_starts"), none.alias("span_ends"), "kept")
    return whole.unionByName(cut)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(documents(spark, sf_dir))
    lost = F.aggregate(F.zip_with("span_starts", "span_ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    return done.select("doc_id", "n_words", lost.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_W = r"[^\x20\x09-\x0D]+"
#: Every window is a row here.
OP6_SQL = f"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') as ws from documents),
words as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from d),
windows as (select doc_id, i, string_agg(w, ' ') over around as words, count(*) over around as n from words window around as (partition by doc_id order by i rows between current row and 12 following)),
again as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by words) as least_ from windows where n = 13) x where least_ < doc_id),
gone as (select distinct doc_id, i + unnest(range(13)) as i from again),
kept as (select doc_id, string_agg(w, ' ' order by i) as kept, count(*) as n from words anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join kept k on k.doc_id = d.doc_id"""
