"""Packing by power-of-two decomposition (operator 5)."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.names import give_back
from tributary.llm.shared import documents

#: Ends each document in the packed stream (fixed by the contract).
END_ID = 2
#: Words whose ids a task remembers (some 10 MB); beyond it the memory starts anew.
REMEMBERED = 500_000
#: Bytes of text handled at a time, and words encoded by one call.
SLICE, CALL = 1 << 22, 256
#: Stands between words in a call; words that hold it are encoded one by one.
_MARK = "\x01"
#: What may follow a word of letters: it is encoded apart.
_TAIL = ".,;:!?"
_PROBE = ["Don't", "naïve—co\u200bol", "ﬁne", "ΑΣ", "12,5", "日本語", "a\tb", "'s", "...", "\u0301x", "<|endoftext|>", "é", "#$%", "İx", "Abc"]


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    return Tokenizer.from_file(path)


def encodes_word_by_word(path: str) -> bool:
    """Whether a text's ids are those of its blank-separated words one after another, a word of
    letters and the marks after it apart, ASCII capitals or not."""
    tokenizer = _tokenizer(path)
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    apart = [i for w in _PROBE for i in encode(w)]
    same = apart == encode(" ".join(_PROBE)) == encode("\n ".join(_PROBE)) and len(encode(_MARK)) == 1
    tails = all(encode(w + t) == encode(w) + encode(t) for w in ("abc", "né", "ж", "日本") for t in (*_TAIL, "?!", "..."))
    return same and tails and encode("ABCXYZ Qq") == encode("abcxyz qq")


class _Ids:
    """Ids of the words seen in a task: word k has ids[first[k] : first[k + 1]]; word 0 stands for a
    document's end."""

    def __init__(self, path: str, end_id: int):
        self.tokenizer, self.end_id = _tokenizer(path), end_id
        self.mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids[0]
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a run of letters
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.words, self.ids, self.first = pa.array([None], pa.large_string()), np.array([self.end_id], np.uint32), np.array([0, 1])

    def _batched(self, words: list[str], between: str) -> np.ndarray:
        calls = [between.join(words[k : k + CALL]) + between for k in range(0, len(words), CALL)]
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(calls, add_special_tokens=False)]
        return np.concatenate(found) if found else np.zeros(0, np.uint32)

    def _of_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, and where each word's end: where a word-end id stands."""
        ids = self._batched(words, " ")
        ends = np.flatnonzero(self.closes[ids]) + 1
        return (ids, ends) if len(ends) == len(words) else self._of_any(words)

    def _of_any(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of any words: a mark stands after each."""
        ids = self._batched([w if _MARK not in w else "" for w in words], f" {_MARK} ")
        marks = np.flatnonzero(ids == self.mark)
        ids, ends = np.delete(ids, marks), marks - np.arange(len(marks))
        for k in reversed([k for k, w in enumerate(words) if _MARK in w]):
            own = self.tokenizer.encode(words[k], add_special_tokens=False).ids
            ids = np.insert(ids, ends[k], np.array(own, np.uint32))
            ends[k:] += len(own)
        return ids, ends

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of words, new ones encoded first."""
        if len(self.words) > REMEMBERED:
            self.forget()
        coded = words.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.words)
        if at.null_count:
            new = coded.dictionary.filter(pc.is_null(at))
            letters = pc.utf8_is_alpha(new)
            parts = new.filter(letters), new.filter(pc.invert(letters))
            at = at.fill_null(-1).to_numpy().copy()
            order = np.argsort(~letters.to_numpy(zero_copy_only=False), kind="stable")
            at[np.flatnonzero(at < 0)[order]] = len(self.words) + np.arange(len(new))
            for part, encoded in zip(parts, (self._of_letters, self._of_any)):
                ids, ends = encoded(part.to_pylist())
                self.first = np.concatenate([self.first, self.first[-1] + ends])
                self.ids = np.concatenate([self.ids, ids])
            self.words = pa.concat_arrays([self.words, *parts])
        else:
            at = at.to_numpy()
        return at[coded.indices.to_numpy()]

    @staticmethod
    def joined(number: np.ndarray, first: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids[first[k] : first[k + 1]] of each number k one after another, and where each ends."""
        size = np.diff(first)[number]
        ends = np.cumsum(size)
        return ids[np.arange(size.sum()) + np.repeat(first[number] - ends + size, size)], ends

    def of(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by its end, and how many each text has."""
        parts = pc.split_pattern(pc.replace_substring(text, "\n", " "), " ")
        ends = parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py()
        words = parts.flatten().dictionary_encode()
        low = pc.ascii_lower(words.dictionary)
        stem = pc.utf8_rtrim(low, _TAIL)
        apart = pc.utf8_is_alpha(stem)
        stem = pc.if_else(apart, stem, low)
        longer = pc.greater(pc.binary_length(low), pc.binary_length(stem))
        cut = [w[len(s) :] for w, s in zip(low.filter(longer).to_pylist(), stem.filter(longer).to_pylist())]
        tail = pc.replace_with_mask(pa.repeat(pa.scalar("", low.type), len(low)), longer, pa.array(cut, low.type))
        both = self.numbers(pa.concat_arrays([stem, tail])).reshape(2, -1).T.ravel()
        ids, stops = self.joined(both, self.first, self.ids)  # of each distinct word here
        first = np.concatenate([[0], stops[1::2], [len(ids) + 1]])  # and, last, of a document's end
        number = np.insert(words.indices.to_numpy(), ends, len(low))
        ids, stops = self.joined(number, first, np.append(ids, np.uint32(self.end_id)))
        return ids, np.diff(np.concatenate([[0], stops[ends + np.arange(len(ends))]]))


def decompose(n: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of documents of n ids: full ones, then the rest's binary digits, longest first. Gives
    each piece's document and length."""
    full, rest = n // largest, n % largest
    doc, length = [np.repeat(np.arange(len(n)), full)], [np.full(full.sum(), largest)]
    for k in range(largest.bit_length() - 2, -1, -1):
        own = np.flatnonzero(rest >> k & 1)
        doc.append(own)
        length.append(np.full(len(own), 1 << k))
    doc, length = np.concatenate(doc), np.concatenate(length)
    order = np.argsort(doc, kind="stable")
    return doc[order], length[order]


def _slices(batch: pa.RecordBatch):
    """(doc_ids, texts) of rows that hold about SLICE bytes together."""
    text = batch.column(1).cast(pa.large_string()).fill_null("")
    ends = np.cumsum(pc.binary_length(text).to_numpy()) if len(text) else np.zeros(0, np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE)) + 1), len(text)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.column(0).slice(a, b - a), text.slice(a, b - a)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("ids", pa.binary())])


def pack_powers_of_two(docs: DataFrame, tokenizer_path: str, max_length: int = 4096, end_id: int = END_ID) -> DataFrame:
    """Cut every document's ids into pieces of power-of-two lengths; each piece is a sequence.

    A document's ids are its text's by the tokenizer file, then `end_id`. It is split into pieces
    of `max_length` (a power of two) and the binary digits of the rest. As sequences of equal
    length are batched together (column `bucket`, the length's logarithm) none needs padding and
    none crosses documents. The words between blanks are encoded once each; a tokenizer whose ids
    depend on more than that is refused.

    Gives per piece doc_id, start, length, doc_tokens, sequence_id, offset (always 0), bucket and
    ids (binary, little-endian unsigned 32-bit). sequence_id is unique; its numbering follows the
    input's partitions. Null or empty text gives one piece holding `end_id`; repeated rows are
    packed each; null doc_id stays null; other columns are ignored; an empty table gives none.
    A task holds one Arrow batch and the ids of at most REMEMBERED words, and keeps nothing.
    """
    if max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    if not encodes_word_by_word(tokenizer_path):
        raise ValueError(f"{tokenizer_path}: its ids of a text are not those of its words")

    def pieces(batches):
        known = _Ids(tokenizer_path, end_id)
        sequence = TaskContext.get().partitionId() << 36
        for batch in batches:
            for doc_id, text in _slices(batch):
                ids, n = known.of(text)
                doc, length = decompose(n, max_length)
                ends = np.cumsum(length)
                start = ends - length - (np.cumsum(n) - n)[doc]
                offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([doc_id.take(pa.array(doc)).cast(pa.int64()), pa.array(start), pa.array(length), pa.array(n[doc]), pa.array(sequence + np.arange(len(doc))), data], schema=_SCHEMA)
                sequence += len(doc)
                del ids, data
            give_back()

    cut = docs.select("doc_id", "text").mapInArrow(pieces, "doc_id long, start long, length long, doc_tokens long, sequence_id long, ids binary")
    return cut.select("doc_id", "start", "length", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), F.log2("length").cast("int").alias("bucket"), "ids")


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per sequence length, so a reader batches equal lengths."""
    packed.write.partitionBy("bucket").parquet(path)


def read_bucket(spark: SparkSession, path: str, bucket: int) -> DataFrame:
    """The sequences of 2^bucket ids: rows of one length, which stack without padding."""
    return spark.read.parquet(path).where(F.col("bucket") == bucket)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_powers_of_two(documents(spark, sf_dir), tokenizer_file())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
