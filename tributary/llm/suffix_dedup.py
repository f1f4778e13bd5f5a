"""Suffix-array dedup (operator 1): removal of bytes that lie in a repeated long string.

Blockwise construction, one bucket of suffixes at a time, for suffixes compared to a fixed depth:

1. Cover sample. Synchronised positions (least name of the `gram` bytes at each, among the starts
   that fit a window of `length` bytes) are a difference cover whose places follow the text: equal
   windows hold equal samples at equal offsets, the least gram of a window always among them.
   Samples are ranked by name; where no other place has the least gram, the suffix has no equal.
2. Buckets. Every other window is placed by its least gram. Counts of tied samples cut the grams into
   buckets of about one size; a gram that is too frequent for a bucket is parted by what stands
   around it. Suffixes that follow one another in a bucket are sent as one line of bytes.
3. Suffix array. A bucket's suffixes are sorted by their bytes, eight at a time. Those tied in all
   `length` bytes have one rank, the name of the whole string, and are sorted once, so that long ties
   cost nothing. Neighbours in that order that agree, compared as bytes, are repeats.

A chunk sends each string once, however often it has it. A task holds one chunk (1 MB of text, or
one longer document) or one bucket.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.exchange import BINS, NAME, SENT, Groups, bin_counts, bits_back, bits_of, by_name, distinct, exchange, kept_row, least_bytes, numbered, rows, run_lengths, run_starts, sent_rows
from tributary.llm.names import Named, chunks, packed, slid, synchronised
from tributary.llm.shared import BROADCAST_ROWS, documents, matched, spread, stage, text_key

GRAM = 64
#: Suffixes around a frequent gram that are parted together.
BLOCK = 16


def _ids(batch) -> tuple[list, np.ndarray]:
    return batch.column("doc_id").to_pylist(), batch.column("key").to_numpy()


def _samples(buckets: int, length: int, gram: int):
    def map_chunks(batches):
        number = numbered()
        for batch, x, ends in chunks(batches):
            every = Named(x).every(gram)
            at = synchronised((every >> np.uint64(32)).astype(np.uint32), length - gram + 1)
            doc = np.searchsorted(ends, at, "right")
            at = at[at + gram <= ends[doc]] if len(at) else at
            names, which, count = distinct(every[at])
            chunk, bucket = next(number), by_name(names, buckets)
            kept = kept_row(buckets, chunk, (_ids(batch), ends, at.astype(np.uint32), which.astype(np.uint32), np.packbits(count > 1), least_bytes(bucket), (names % np.uint64(BINS)).astype(np.uint16)))
            yield rows([*sent_rows(chunk, names, bucket), kept])

    return map_chunks


def _ties(names: np.ndarray, cuts: np.ndarray) -> list[bytes | None]:
    _, which, count = distinct(names)
    return bits_back(count[which] > 1, cuts)


def _tied(kept, back) -> pd.DataFrame:
    """Places of the tied samples, by document."""
    (ids, keys), ends, at, which, several, bucket, bins = kept
    tied = np.unpackbits(several, count=len(bucket)).astype(bool) | bits_of(back, bucket)
    at, bins = at[tied[which]].astype(np.int64), bins[which][tied[which]]
    doc, starts = np.searchsorted(ends, at, "right"), np.concatenate([[0], ends[:-1]])
    cut = run_starts(doc) if len(doc) else []
    found = [(ids[doc[a]], keys[doc[a]], packed(at[a:b] - starts[doc[a]], "<u4"), packed(bins[a:b], "<u2")) for a, b in zip(cut, [*cut[1:], len(doc)])]
    return pd.DataFrame(found, columns=["doc_id", "key", "near", "bins"]).astype({"doc_id": "Int64"})


def _covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    edge = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0


def _runs(mask: np.ndarray) -> np.ndarray:
    """Where runs of true begin and end."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).reshape(-1, 2)


def _placed(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for `size` steps, of all runs one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def _suffixes(groups: Groups, length: int, gram: int):
    reach, block = length - gram, min(BLOCK, length)

    def map_chunks(batches):
        number = numbered()
        for batch, x, ends in chunks(batches):
            chunk, starts = next(number), np.concatenate([[0], ends[:-1]])
            near = [np.frombuffer(v.as_py(), "<u4").astype(np.int64) + s for v, s in zip(batch.column("near"), starts)]
            named = Named(x)
            every = named.every(gram)
            tied = np.zeros(len(every), bool)
            tied[np.concatenate(near) if near else np.zeros(0, np.int64)] = True
            order = (every >> np.uint64(32)) << np.uint64(31) | np.arange(len(every), dtype=np.uint64)
            lead = (slid(order, reach + 1, np.minimum) & np.uint64((1 << 31) - 1)).astype(np.int64) if len(every) > reach else np.zeros(0, np.int64)
            inside = _covered(len(lead), *np.minimum([starts, np.maximum(ends - length + 1, starts)], len(lead)))
            at = np.flatnonzero(tied[lead] & inside)
            same = Alike(named.of(at, at + length))
            sent = np.sort(same.order[same.first])
            a, p = at[sent], lead[at[sent]]
            low = p - (p - a) // block * block - block + 1  # suffixes a of one block share what follows low + block - 1
            bucket = groups.of(every[p], named.of(low + block - 1, low + length))
            turn = np.argsort(bucket, kind="stable")
            a, bucket = a[turn], bucket[turn]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1] + 1) | (bucket[1:] != bucket[:-1])
            line = np.flatnonzero(new)
            size = run_lengths(line, len(a))
            own, b = a[line], bucket[line]
            text = x[_placed(own, size + length - 1)].tobytes()
            stops, out = np.concatenate([[0], np.cumsum(size + length - 1)]), []
            cut = [*run_starts(b), len(b)] if len(b) else [0]
            for lo, hi in zip(cut[:-1], cut[1:]):
                out.append((int(b[lo]), chunk, int(hi - lo).to_bytes(4, "little") + packed(size[lo:hi], "<u4") + text[stops[lo] : stops[hi]], None))
            known = np.zeros(len(x) + 1, bool)
            known[at[same.order[np.repeat(same.count > 1, same.count)]]] = True
            kept = kept_row(groups.buckets, chunk, (_ids(batch), x.tobytes(), ends, own.astype(np.uint32), size.astype(np.uint32), least_bytes(b), _runs(known).astype(np.uint32)))
            yield rows([*out, kept])

    return map_chunks


class Alike:
    """Equal names one after another: the order, where each name begins in it, how often it occurs."""

    def __init__(self, names: np.ndarray):
        self.order = np.argsort(names, kind="stable")
        self.first = run_starts(names[self.order])
        self.count = run_lengths(self.first, len(names))


class SuffixArray:
    """Some suffixes of a text, each `depth` bytes long at least, in the order of those bytes."""

    def __init__(self, x: np.ndarray, at: np.ndarray, depth: int):
        w = np.concatenate([x, np.zeros(7, np.uint8)]).astype(np.uint64)
        for k in (1, 2, 4):  # eight bytes from every place on, as one number
            w = w[:-k] << np.uint64(8 * k) | w[k:]
        self.words, self.at = w, at
        self.steps = [*range(0, depth - 8, 8), depth - 8]
        same = Alike(Named(x).of(at, at + depth))
        one = at[same.order[same.first]]  # one for each rank; the others stand beside it
        order = np.argsort(w[one], kind="stable")
        todo, key = np.arange(len(one)), w[one[order]]  # places in the order that are tied, by group
        group = np.zeros(len(one), np.int64)
        for step in self.steps[1:]:
            new = np.ones(len(todo), bool)
            new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
            tied = ~new
            tied[:-1] |= ~new[1:]
            if not tied.any():
                break
            todo, group = todo[tied], np.cumsum(new)[tied]
            key = w[one[order[todo]] + step]
            turn = np.lexsort((key, group))
            order[todo], key = order[todo][turn], key[turn]
        size = same.count[order]
        self.order = same.order[_placed(same.first[order], size)]
        self.new = np.zeros(len(at), bool)
        self.new[np.cumsum(size) - size] = True

    def repeated(self) -> np.ndarray:
        """Which suffixes agree with a neighbour in the order in all bytes, in the order of `at`."""
        tie = np.flatnonzero(~self.new)
        a, b = self.at[self.order[tie - 1]], self.at[self.order[tie]]
        same = np.ones(len(tie), bool)
        for step in self.steps:
            same &= self.words[a + step] == self.words[b + step]
        out = np.zeros(len(self.at), bool)
        out[self.order[tie[same] - 1]] = out[self.order[tie[same]]] = True
        return out


def _equal_suffixes(length: int):
    def answer(parts: list[bytes]) -> list[bytes | None]:
        n = [int.from_bytes(x[:4], "little") for x in parts]
        size = [np.frombuffer(x, "<u4", k, 4).astype(np.int64) for x, k in zip(parts, n)]
        x = np.frombuffer(b"".join(x[4 + 4 * k :] for x, k in zip(parts, n)), np.uint8)
        each = np.concatenate(size)
        stops = np.cumsum(each + length - 1)
        found = SuffixArray(x, _placed(stops - each - length + 1, each), length).repeated()
        return bits_back(found, np.cumsum([0, *(s.sum() for s in size)]))

    return answer


def _removals(length: int):
    def finish(kept, back) -> pd.DataFrame:
        (ids, keys), text, ends, own, size, bucket, known = kept
        x, own, size, known, found, start = np.frombuffer(text, np.uint8), own.astype(np.int64), size.astype(np.int64), known.astype(np.int64), [], 0
        at = _placed(own, size)[bits_of(back, np.repeat(bucket, size))]
        gone = _covered(len(x), np.concatenate([known[:, 0], at]), np.concatenate([known[:, 1] + length - 1, at + length]))
        for k, end in enumerate(ends):
            g = gone[start:end]
            edge = _runs(g)
            found.append((ids[k], keys[k], edge[:, 0].tolist(), edge[:, 1].tolist(), x[start:end][~g].tobytes()))
            start = end
        return pd.DataFrame(found, columns=["doc_id", "key", "starts", "ends", "kept"]).astype({"doc_id": "Int64"})

    return finish


def suffix_array_dedup(docs: DataFrame, length: int = 200, gram: int = GRAM) -> DataFrame:
    """Remove from every text each byte covered by a `length`-byte string that starts anywhere else.

    Takes any DataFrame with doc_id (long) and text (string). Gives one row per input row:
    doc_id, key, n_bytes, span_starts and span_ends (arrays of the maximal removed runs, in bytes
    of the UTF-8 text) and kept (binary). Matches never cross documents; strings are judged on
    the input. Null text counts as empty; texts under `length` bytes keep everything; rows that
    repeat, doc_id and text alike, are copies of each other and lose what they share; a null
    doc_id is a value like others; other columns are ignored, whatever their names; an empty
    table gives an empty result. `gram` is at most `length`, and that at least eight.
    """
    if not 0 < gram <= length or length < 8:
        raise ValueError("gram must be between 1 and length, and length 8 at least")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    buckets = spread(docs.sparkSession, docs)
    sent = docs.mapInArrow(_samples(buckets, length, gram), SENT)
    flags = exchange(sent, buckets, NAME, _ties, _tied, "doc_id long, key long, near binary, bins binary")
    flags = stage(flags.dropDuplicates(["doc_id", "key"]), "ties")  # repeated rows have the same ties
    flagged = flags.select("doc_id", "key")
    if flagged.count() <= BROADCAST_ROWS:
        flagged = F.broadcast(flagged)  # two longs a row; a larger set is joined by shuffle
    groups = Groups(bin_counts(flags), 2 * buckets)
    tied = matched(docs, flagged, "left_semi")
    free = matched(docs, flagged, "left_anti")
    tied = matched(tied, flags, "inner", "merge").select("doc_id", "key", "text", "near")
    cut = exchange(tied.mapInArrow(_suffixes(groups, length, gram), SENT), groups.buckets, None, _equal_suffixes(length), _removals(length), "doc_id long, key long, starts array<int>, ends array<int>, kept binary")
    none = F.array().cast("array<int>")
    whole = free.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("span_starts"), none.alias("span_ends"), F.col("text").cast("binary").alias("kept"))
    lost = F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    return whole.unionByName(cut.select("doc_id", "key", (F.octet_length("kept") + lost).cast("long").alias("n_bytes"), F.col("starts").alias("span_starts"), F.col("ends").alias("span_ends"), "kept"))


def kept_text(kept: Column) -> Column:
    """The kept bytes as text; bytes that no longer form a character are left out."""
    return F.replace(F.make_valid_utf8(kept.cast("string")), F.lit("\ufffd"), F.lit(""))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_array_dedup(documents(spark, sf_dir))
    n_kept = F.octet_length("kept")
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - n_kept).cast("long").alias("n_removed"), F.size("span_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The digest of every 200-byte string is a row here; runs of removed bytes are islands of their starts.
OP1_SQL = """with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
strings as (select r, i, md5(b[i:i + 199]) as h from (select r, b, unnest(range(1, octet_length(b) - 198)) as i from d where octet_length(b) >= 200) x),
again as (select r, i from (select r, i, count(*) over (partition by h) as k from strings) x where k > 1),
steps as (select r, i, case when i - lag(i) over (partition by r order by i) <= 200 then 0 else 1 end as new_ from again),
islands as (select r, i, sum(new_) over (partition by r order by i) as island from steps),
spans as (select r, island, min(i) as first_, max(i) + 200 as end_ from islands group by r, island),
counts as (select r, cast(sum(end_ - first_) as bigint) as n_removed, count(*) as n_spans, max(end_) as last_ from spans group by r),
gaps as (select r, coalesce(lag(end_) over (partition by r order by first_), 1) as start_, first_ as end_ from spans),
pieces as (select g.r, string_agg(hex(b[g.start_:g.end_ - 1]), '' order by g.start_) as kept from gaps g join d on d.r = g.r where g.end_ > g.start_ group by g.r)
select d.doc_id, octet_length(b) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(case when c.r is null then b else unhex(concat(coalesce(kept, ''), case when last_ <= octet_length(b) then hex(b[last_:octet_length(b)]) else '' end)) end) as kept_sha256
from d left join counts c on c.r = d.r left join pieces p on p.r = d.r"""
