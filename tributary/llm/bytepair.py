"""Byte-level BPE by a lazily determinised transducer, and a streaming decoder (operator 11).

Merging by rank has a local form: a row of tokens is what merging gives if and only if no two
neighbours would have met differently, which the merges behind the two tell (`Ranks.apart`). So the
encodings of all prefixes of a text are paths of a nondeterministic transducer whose states are places
in the trie of tokens, each with the token before it. `Transducer` makes it deterministic: a state is
the set of such places that are still possible, made when it is first reached, and one of them always
stands between two tokens, so each state also names the last token of the prefix read. A token is
emitted once all places go back to it, at most a few tokens' length of bytes later. Texts of any length
are read once, byte by byte, in memory that doesn't grow with them.

Decoding is a second machine of the same kind: its states are the bytes of a character begun but not
ended, its moves are tokens, learned from the table of well-formed UTF-8.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.names import give_back
from tributary.llm.shared import documents

#: Bounds of a worker's memory: states of the transducer, pieces whose ids are remembered (and their
#: longest), moves of the decoder. Beyond each the memory starts anew; results don't depend on them.
STATES, PAIRS, PIECES, LONGEST, MOVES = 250_000, 60_000, 150_000, 64, 60_000
#: Most tokens beyond a place that are looked at for one that a way could go on with.
LOOKED = 8
#: Bytes read between two looks at what is certain.
WINDOW = 256
#: Ids of an output batch.
IDS = 1 << 19
ROOT, START = 0, -1


class Ranks:
    """Tokens by rank: what each was merged of last, and a trie of all."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.rank = tokens, {t: k for k, t in enumerate(tokens)}
        if missing := [b for b in range(256) if bytes([b]) not in self.rank]:
            raise ValueError(f"no token for bytes {missing[:5]}")
        self.left, self.right = [START] * len(tokens), [START] * len(tokens)
        for k, t in enumerate(tokens):
            if len(t) > 1:
                self.left[k], self.right[k] = self._last_merge(k, t)
        self.next, self.token, self.depth, self.low, self.high = [{}], [START], [0], [0], [len(tokens)]
        self.ordered = sorted(range(len(tokens)), key=tokens.__getitem__)
        for place, k in enumerate(self.ordered):
            node = ROOT
            for b in tokens[k]:
                if b not in self.next[node]:
                    self.next[node][b] = len(self.next)
                    self.next.append({})
                    self.token.append(START)
                    self.depth.append(self.depth[node] + 1)
                    self.low.append(place)
                    self.high.append(place)
                node = self.next[node][b]
                self.high[node] = place + 1
            self.token[node] = k
            self.low[node] += 1  # the tokens beyond a place are ordered[low:high]

    def _last_merge(self, k: int, t: bytes) -> tuple[int, int]:
        for cut in range(1, len(t)):
            a, b = self.rank.get(t[:cut], k), self.rank.get(t[cut:], k)
            if a < k and b < k and self._meet(a, b):
                return a, b
        raise ValueError(f"merges by rank never give token {t!r}")

    def _meet(self, a: int, b: int) -> bool:
        """Whether both sides of a border come to be a and b before anything is merged across it: the
        merges of the two are undone, latest first, and what lay at the border then must not have had
        a rank before the merge undone. Of equal ranks the one more to the left comes first."""
        rank, tokens, left, right = self.rank, self.tokens, self.left, self.right
        while left[a] >= 0 or left[b] >= 0:
            if left[b] < 0 or left[a] >= 0 and a > b:
                before, a = a, right[a]
            else:
                before, b = b + 1, left[b]
            if rank.get(tokens[a] + tokens[b], before) < before:
                return False
        return True

    def apart(self, a: int, b: int) -> bool:
        """Whether a and b side by side stay two tokens."""
        return self.tokens[a] + self.tokens[b] not in self.rank and self._meet(a, b)


class Transducer:
    """Bytes in, ids out. A state is a tuple of ways: the last whole token and the place in the next
    one. The first way is the one between two tokens."""

    def __init__(self, ranks: Ranks):
        self.ranks, self.known, self.ways, self.last, self.moves, self.leads = ranks, {}, [], [], {}, {}
        self.apart = lru_cache(PAIRS)(ranks.apart)
        self.start = self._state(((START, ROOT),))

    def _state(self, ways: tuple) -> int:
        state = self.known.get(ways)
        if state is None:
            state = self.known[ways] = len(self.ways)
            self.ways.append(ways)
            self.last.append(ways[0][0])
        return state

    def _leads(self, last: int, node: int) -> bool:
        """Whether a token beyond this place can follow `last`; of more than LOOKED one is taken to. A way
        that leads nowhere only makes states more numerous."""
        low, high = self.ranks.low[node], self.ranks.high[node]
        if high - low > LOOKED or last == START:
            return low < high
        key = last << 32 | node
        if key not in self.leads:
            if len(self.leads) >= PAIRS:
                self.leads.clear()
            self.leads[key] = any(self.apart(last, t) for t in self.ranks.ordered[low:high])
        return self.leads[key]

    def _move(self, state: int, byte: int) -> int:
        """The state after one more byte."""
        ranks, ended, ways = self.ranks, None, []
        for last, node in self.ways[state]:
            node = ranks.next[node].get(byte)
            if node is None:
                continue
            if self._leads(last, node):
                ways.append((last, node))
            token = ranks.token[node]
            if ended is None and token >= 0 and (last == START or self.apart(last, token)):
                ended = token
        if len(self.ways) >= STATES:
            self.known, state = {self.ways[0]: self.start}, None
            del self.ways[1:], self.last[1:]
            self.moves.clear()
        after = self._state(((ended, ROOT), *ways))
        if state is not None:
            self.moves[state << 8 | byte] = after
        return after

    def _certain(self, state: int, lasts: list[int]) -> int:
        """How many of the bytes read are of tokens that every way goes back to."""
        common = None
        for _, node in self.ways[state]:
            at, stops = len(lasts) - self.ranks.depth[node], set()
            while at > 0:
                stops.add(at)
                at -= len(self.ranks.tokens[lasts[at - 1]])
            common = stops if common is None else common & stops
        return max(common, default=0)

    def _back(self, lasts: list[int], end: int) -> list[int]:
        """The tokens of the first `end` bytes, from the last token of each prefix."""
        out, tokens = [], self.ranks.tokens
        while end:
            out.append(lasts[end - 1])
            end -= len(tokens[out[-1]])
        out.reverse()
        return out

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of the chunks' bytes taken together, each soon after it is certain; what is held between
        is WINDOW bytes' last tokens."""
        state, known, lasts, last = self.start, self.moves.get, [], self.last
        for byte in chain.from_iterable(chunks):
            state = known(state << 8 | byte) or self._move(state, byte)
            lasts.append(last[state])
            if not len(lasts) % WINDOW:
                certain = self._certain(state, lasts)
                yield from self._back(lasts, certain)
                del lasts[:certain]
        yield from self._back(lasts, len(lasts))

    def encode(self, data: bytes) -> list[int]:
        if len(data) >= WINDOW:
            return list(self.stream((data,)))
        state, known, lasts, last = self.start, self.moves.get, [], self.last
        for byte in data:
            state = known(state << 8 | byte) or self._move(state, byte)
            lasts.append(last[state])
        return self._back(lasts, len(lasts))


#: Well-formed UTF-8. A leading byte's range, how many bytes follow, and the range of the
#: first of them; further ones are 80 to BF.
WELL_FORMED = (
    (0x00, 0x7F, 0, None),
    (0xC2, 0xDF, 1, (0x80, 0xBF)),
    (0xE0, 0xE0, 2, (0xA0, 0xBF)),
    (0xE1, 0xEC, 2, (0x80, 0xBF)),
    (0xED, 0xED, 2, (0x80, 0x9F)),
    (0xEE, 0xEF, 2, (0x80, 0xBF)),
    (0xF0, 0xF0, 3, (0x90, 0xBF)),
    (0xF1, 0xF3, 3, (0x80, 0xBF)),
    (0xF4, 0xF4, 3, (0x80, 0x8F)),
)


def _after(lead: int, place: int) -> tuple[int, int, int] | None:
    """What may stand at `place` after a leading byte (its range), and how many bytes are then still to
    come; None for a byte that cannot lead."""
    for low, high, more, first in WELL_FORMED:
        if low <= lead <= high:
            return (*(first if place == 1 else (0x80, 0xBF)), more - place) if place else (low, high, more)
    return None


class Decoder:
    """Ids in, text out: characters come as soon as they are whole; what is no UTF-8 becomes U+FFFD, one
    for each longest part that could have begun a character."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.moves, self.held = tokens, {}, b""

    def _read(self, held: bytes, data: bytes) -> tuple[bytes, str]:
        out, begun = [], held
        for byte in data:
            may = _after(begun[0], len(begun)) if begun else _after(byte, 0)
            if begun and not may[0] <= byte <= may[1]:
                out.append("�")
                begun, may = b"", _after(byte, 0)
            if may is None:
                out.append("�")
                continue
            begun += bytes([byte])
            if not may[2]:
                out.append(begun.decode("utf-8"))
                begun = b""
        return begun, "".join(out)

    def push(self, ids: Iterable[int]) -> str:
        held, moves, out = self.held, self.moves, []
        for k in ids:
            move = moves.get((held, k))
            if move is None:
                if len(moves) >= MOVES:
                    moves.clear()
                move = moves[held, k] = self._read(held, self.tokens[k])
            held, text = move
            out.append(text)
        self.held = held
        return "".join(out)

    def close(self) -> str:
        """What is left: a character that never ended."""
        rest, self.held = "�" if self.held else "", b""
        return rest


class _Pieces(dict):
    """Ids of the pieces met lately; a long piece is read anew each time."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, piece: str) -> list[int]:
        ids = self.transducer.encode(piece.encode("utf-8"))
        if len(piece) <= LONGEST:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = ids
        return ids


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a file of lines `base64 rank`; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [found[k] for k in range(len(found))]


@cache
def _tokens(path: str) -> list[bytes]:
    return read_ranks(path)


@cache
def _pieces(path: str) -> _Pieces:
    """A worker compiles a file once, whatever the number of its tasks."""
    return _Pieces(Transducer(Ranks(_tokens(path))))


@cache
def _decoder(path: str) -> Decoder:
    return Decoder(_tokens(path))


#: Stands for the code points that `regex` takes for letters or digits and tiktoken's older tables don't:
#: neither of the two, and no white space, for either.
NEITHER = "\u0378"


@cache
def _splitter(pattern: str):
    """A function that cuts a text as tiktoken does. The two libraries' tables of letters, digits and
    white space are compared once a worker; texts that hold a code point on which they differ are cut by
    a copy in which NEITHER stands for it."""
    import regex
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    matches, odd = regex.compile(pattern), set()
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        theirs = set(bytes(tiktoken.Encoding("one", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode())
        ours = set(regex.findall(kind, every))
        if theirs - ours:
            raise ValueError(f"`regex` does not know {len(theirs - ours)} code points of {kind}")
        odd |= ours - theirs
    stand = dict.fromkeys(map(ord, odd), NEITHER)

    def split(text: str) -> list[str]:
        if text.isascii() or odd.isdisjoint(text):
            return matches.findall(text)
        return [text[m.start() : m.end()] for m in matches.finditer(text.translate(stand))]

    return split


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds `ids` (array of int) to each row: the ids of its `text`, and drops the text.

    Each match of `pattern` (syntax of the `regex` library) is encoded by itself, by the ranks in the
    file, without special tokens; what no match covers has no ids. A null or empty text has none; rows
    that repeat are encoded each; other columns stay as they are (one named `ids` is replaced); an empty
    table gives none. A task holds one Arrow batch, IDS ids and the worker's bounded memory.
    """
    others = [c for c in docs.columns if c not in ("text", "ids")]
    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def encoded(batches):
        split, pieces = _splitter(pattern), _pieces(ranks_path)
        for batch in batches:
            texts, ids, ends, begin = batch.column(len(others)), [], [0], 0
            for k in range(len(texts)):
                text = texts[k].as_py()
                found = np.fromiter(chain.from_iterable(map(pieces.__getitem__, split(text))), np.int32) if text else np.zeros(0, np.int32)
                ids.append(found)
                ends.append(ends[-1] + len(found))
                if ends[-1] >= IDS or k + 1 == len(texts):
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(begin, k + 1 - begin) for c in range(len(others))), lists], names=[*others, "ids"])
                    ids, ends, begin = [], [0], k + 1
            give_back()

    return docs.select(*[F.col(f"`{c}`") for c in others], "text").mapInArrow(encoded, schema)


def decode(rows: DataFrame, ranks_path: str) -> DataFrame:
    """Adds `text` to each row: what its `ids` stand for, and drops the ids.

    Bytes that are no UTF-8 become U+FFFD. Null or empty ids give an empty text, a null id or one that
    has no token nothing; rows that repeat are decoded each; other columns stay as they are (one named
    `text` is replaced); an empty table gives none.
    """
    others = [c for c in rows.columns if c not in ("text", "ids")]
    schema = T.StructType([rows.schema[c] for c in others] + [T.StructField("text", T.StringType())])

    def decoded(batches):
        decoder, known = _decoder(ranks_path), len(_tokens(ranks_path))
        for batch in batches:
            lists = batch.column(len(others))
            texts = []
            for k in range(len(lists)):
                ids = lists[k].values
                ids = np.zeros(0, np.int64) if ids is None else ids.fill_null(-1).to_numpy(zero_copy_only=False)
                texts.append(decoder.push(ids[(ids >= 0) & (ids < known)].tolist()) + decoder.close())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(others))), pa.array(texts, pa.string())], names=[*others, "text"])
            give_back()

    return rows.select(*[F.col(f"`{c}`") for c in others], "ids").mapInArrow(decoded, schema)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = encode(documents(spark, sf_dir).select("doc_id", "text"), path, public_tokenizers.PATTERN)
    told = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), "ids")
    return decode(told, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
