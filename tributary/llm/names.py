"""64-bit names of substrings over chunks of whole documents, all vectorised with numpy.

A chunk is the concatenated UTF-8 of some documents. A substring's name is a polynomial hash
over prefix sums, mixed with its length, so equal substrings have equal names wherever they
stand. Names are exchanged between chunks as packed arrays: a chunk sends each distinct name
once to the task of the name's bucket, so a passage that a third of all documents hold costs
one record per chunk, not one per document.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_libc = ctypes.CDLL(None) if sys.platform == "linux" else None
CHUNK_BYTES = (1 << 20) - 1  # so that a table of powers of 2^20 entries will do
_U = np.uint64
_BASE, _C1, _C2 = 0x9E3779B97F4A7C15, _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_power: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h = h * _C1
    h ^= h >> _U(27)
    h *= _C2
    h ^= h >> _U(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=_U)) | _U(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse. Those for a chunk stay; a longer text's are made anew."""
    if _power and n <= len(_power[0]):
        return _power[0][:n], _power[1][:n]
    made = [np.full(max(n, CHUNK_BYTES + 1), base, _U) for base in (_BASE, pow(_BASE, -1, 2**64))]
    for p in made:
        p[0] = 1
        np.multiply.accumulate(p, out=p)
    if n <= CHUNK_BYTES + 1:
        _power[:] = made
    return made[0][:n], made[1][:n]


def give_back() -> None:
    """Memory that is free goes back to the system: a Python worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_libc, "malloc_trim", None):
        trim(0)


class Named:
    """Names of ranges of a sequence of 64-bit values (bytes by default)."""

    def __init__(self, values: np.ndarray):
        values = _BYTE[values] if values.dtype == np.uint8 else values
        self.n = len(values)
        power, self.inverse = _powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, _U)
        np.cumsum(values * power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(_U) * _C2)

    def every(self, length: int) -> np.ndarray:
        """Names of all ranges of one length."""
        if self.n < length:
            return np.zeros(0, _U)
        raw = (self.sums[length:] - self.sums[:-length]) * self.inverse[: self.n - length + 1]
        return mix(raw + _U(length * int(_C2) % 2**64))


def slid(a: np.ndarray, width: int, best) -> np.ndarray:
    """best over every `width` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        a = best(a[:-span], a[span:])
        span *= 2
    return best(a[: len(a) - (width - span)], a[width - span :]) if span < width else a


def synchronised(order: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the least (ties included) of some `width` neighbours.

    Which ones depends on the neighbours alone, so two equal stretches of `width` share the
    offsets of all their positions: what a difference cover gives, at a density of 2/width.
    """
    n = len(order)
    if n < width:
        return np.flatnonzero(order == order.min()) if n else np.zeros(0, np.int64)
    least = slid(order, width, np.minimum)
    edge = np.zeros(width - 1, least.dtype)
    return np.flatnonzero(slid(np.concatenate([edge, least, edge]), width, np.maximum) == order)


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their UTF-8 text as one uint8 array, the documents' ends in it); null is empty."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text")).cast(pa.large_string()).fill_null("")
        at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(text):
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first), data[at[first] : at[last]], at[first + 1 : last + 1] - at[first]
            first = last
        give_back()


def words_of(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the white-space separated words of a chunk, and each one's document."""
    blank = (x == 32) | ((x >= 9) & (x <= 13))
    edge = np.zeros(len(x) + 1, bool)  # a document's start parts words too
    edge[ends[:-1]] = True
    edge[0] = edge[-1] = True
    before = np.concatenate([[True], blank])
    start = np.flatnonzero(~blank & (before[:-1] | edge[:-1]))
    end = np.flatnonzero(~before & np.concatenate([blank | edge[:-1], [True]]))
    return start, end, np.searchsorted(ends, start, "right")


def packed(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, dtype=kind).tobytes()
