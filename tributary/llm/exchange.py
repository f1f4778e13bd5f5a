"""Exchange of names between chunks, as one Spark shuffle by bucket and one back by chunk.

A mapper yields, for each of its chunks, `sent` rows (a bucket's records, sorted by name) and one
`kept` row (what it needs when the answers are back). Chunk numbers hold the task's partition.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.names import give_back

SENT = "bucket long, chunk long, records binary, kept binary"
_ARROW = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("records", pa.binary()), ("kept", pa.binary())])
NAME = np.dtype("<u8")
#: Bins in which sampled grams are counted.
BINS = 1 << 16


def numbered() -> Iterator[int]:
    """Numbers of this task's chunks."""
    base = TaskContext.get().partitionId() << 32
    while True:
        yield base
        base += 1


def rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _ARROW.types)], schema=_ARROW)


def kept_row(buckets: int, chunk: int, kept: object) -> tuple:
    """Dealt over as many other buckets, as it only passes through."""
    return buckets + ((chunk * 0x9E3779B97F4A7C15 % 2**64) >> 32) % buckets, chunk, None, pickle.dumps(kept, protocol=5)


def sent_rows(chunk: int, records: np.ndarray, bucket: np.ndarray) -> list[tuple]:
    """records sorted by bucket."""
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(records)] if len(records) else []
    return [(int(bucket[lo]), chunk, records[lo:hi].tobytes(), None) for lo, hi in zip(cuts[:-1], cuts[1:])]


def by_name(names: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets as equal ranges of names."""
    return (((names >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows equal in all columns begins."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def run_lengths(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(first, n))


def exchange(sent: DataFrame, buckets: int, record: np.dtype | None, answer: Callable, finish: Callable, schema: str) -> DataFrame:
    """answer(records, cuts) gives an answer (bytes, or None for nothing) to each sending row, whose
    records lie between two cuts; without a record type it is answer(what each row sent). finish(kept, answers by bucket) makes a chunk's rows."""

    def in_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["bucket"].iloc[0] >= buckets:
            return pd.DataFrame({"chunk": pdf["chunk"], "bucket": -1, "back": None, "kept": pdf["kept"]})
        parts = list(pdf["records"]) if record is None else [np.frombuffer(x, record) for x in pdf["records"]]
        back = answer(parts) if record is None else answer(np.concatenate(parts), np.cumsum([0, *map(len, parts)]))
        told = [k for k, b in enumerate(back) if b is not None]
        del parts
        give_back()
        return pd.DataFrame({"chunk": pdf["chunk"].to_numpy()[told], "bucket": pdf["bucket"].to_numpy()[told], "back": [back[k] for k in told], "kept": [None] * len(told)})

    def in_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        back = {b: x for b, x in zip(pdf["bucket"], pdf["back"]) if x is not None}
        out = finish(pickle.loads(next(x for x in pdf["kept"] if x is not None)), back)
        del back
        give_back()
        return out

    back = sent.groupBy("bucket").applyInPandas(in_bucket, "chunk long, bucket long, back binary, kept binary")
    return back.groupBy("chunk").applyInPandas(in_chunk, schema)


def distinct(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct names, which of them each name is, and how often each occurs."""
    order = np.argsort(names, kind="stable")
    first = run_starts(names[order])
    count = run_lengths(first, len(names))
    which = np.empty(len(names), np.int64)
    which[order] = np.repeat(np.arange(len(first)), count)
    return names[order[first]], which, count


def bits_back(flag: np.ndarray, cuts: np.ndarray) -> list[bytes | None]:
    """A bit for each record, in its row's order."""
    return [np.packbits(flag[a:b]).tobytes() if flag[a:b].any() else None for a, b in zip(cuts[:-1], cuts[1:])]


def bits_of(back: dict[int, bytes], bucket: np.ndarray) -> np.ndarray:
    """The flags of a chunk's records, which are sorted by bucket."""
    flag = np.zeros(len(bucket), bool)
    for b, bits in back.items():
        lo, hi = np.searchsorted(bucket, [b, b + 1])
        flag[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo)
    return flag


def least_bytes(values: np.ndarray) -> np.ndarray:
    """As bytes if they fit."""
    return values.astype(np.uint8 if not len(values) or values.max() < 256 else np.uint32)


class Groups:
    """Which group a window's suffix is in, from how many samples each bin of grams has.

    Bins in order fill groups of about one size. A bin larger than a group is parted by its grams,
    or, if it is so large that one gram must be behind it, by what the windows hold around the gram.
    """

    def __init__(self, counts: np.ndarray, buckets: int):
        target = max(1.0, counts.sum() / buckets)
        self.hot = counts > max(target, 4 * counts.mean())
        self.parts = np.maximum(np.ceil(counts / target), 1).astype(np.uint64)
        self.first = (np.concatenate([[0], np.cumsum(counts)])[:-1] / target).astype(np.int64)
        self.buckets = int((self.first + self.parts.astype(np.int64)).max()) + 1

    def of(self, gram: np.ndarray, around: np.ndarray) -> np.ndarray:
        b = (gram % np.uint64(BINS)).astype(np.int64)
        return self.first[b] + (np.where(self.hot[b], around, gram >> np.uint64(16)) % self.parts[b]).astype(np.int64)


def _bins_used(batches):
    total = np.zeros(BINS, np.int64)
    for batch in batches:
        total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=BINS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"bin": used, "n": total[used]})


def bin_counts(flags: DataFrame) -> np.ndarray:
    """How many shared samples each bin has, from packed column `bins`: at most BINS rows come back."""
    counts = np.zeros(BINS, np.int64)
    for r in flags.select("bins").mapInArrow(_bins_used, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r["bin"]] = r["n"]
    return counts
