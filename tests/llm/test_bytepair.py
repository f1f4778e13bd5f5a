"""Byte-level BPE against the tiktoken library, and back; the transducer against merging by rank."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tributary.llm import bytepair

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, n_tokens int"


@pytest.fixture(scope="module")
def tokens():
    return bytepair.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(tokens):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})


def _merged(data: bytes, rank: dict[bytes, int]) -> list[int]:
    parts = [data[k : k + 1] for k in range(len(data))]
    while len(parts) > 1:
        best, k = min((rank.get(parts[k] + parts[k + 1], len(rank)), k) for k in range(len(parts) - 1))
        if best == len(rank):
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [rank[p] for p in parts]


def _bytes(rng, tokens):
    few = [rng.randrange(256) for _ in range(3)]
    return [
        bytes(rng.choices(range(256), k=rng.randint(0, 40))),
        b"".join(rng.choices(tokens, k=rng.randint(1, 9))),
        b"".join(rng.choices(tokens[:1500], k=rng.randint(1, 12))),
        bytes(rng.choices(few, k=rng.randint(1, 50))),
        bytes(rng.choices(b"aeinst rh", k=rng.randint(1, 80))),
    ]


def test_transducer_equals_merging(tokens):
    ranks, rng = bytepair.Ranks(tokens), random.Random(2)
    transducer = bytepair.Transducer(ranks)
    for _ in range(1500):
        for data in _bytes(rng, tokens):
            assert transducer.encode(data) == _merged(data, ranks.rank), data


@pytest.mark.parametrize("states, window", [(50, 3), (700, 256), (10**6, 20)])
def test_small_bounds_change_nothing(tokens, library, monkeypatch, states, window):
    """Memory that starts anew all the time, certainty looked at often, bytes that come in chunks."""
    monkeypatch.setattr(bytepair, "STATES", states)
    monkeypatch.setattr(bytepair, "WINDOW", window)
    transducer, rng = bytepair.Transducer(bytepair.Ranks(tokens)), random.Random(4)
    for _ in range(60):
        data = b"".join(_bytes(rng, tokens) * 4)
        cuts = sorted(rng.choices(range(len(data) + 1), k=4))
        chunks = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        assert list(transducer.stream(chunks)) == transducer.encode(data) == library._encode_single_piece(data)


def test_little_is_held_back(tokens, monkeypatch):
    """A run that never ends is emitted while it is read: what is held stays a few tokens long."""
    monkeypatch.setattr(bytepair, "WINDOW", 64)
    transducer, read = bytepair.Transducer(bytepair.Ranks(tokens)), [0]

    def endless():
        for k in range(40):
            read[0] += 1000
            yield b"the sea and then " * 59

    out, lag = 0, []
    for k in transducer.stream(endless()):
        out += len(tokens[k])
        lag.append(read[0] - out)
    assert max(lag) < 1000 + 64 + 4 * max(map(len, tokens))


def test_ranks_that_merging_cannot_reach_are_refused():
    single = [bytes([b]) for b in range(256)]
    with pytest.raises(ValueError, match="never give"):
        bytepair.Ranks([*single, b"abc"])
    with pytest.raises(ValueError, match="no token"):
        bytepair.Ranks(single[1:])


def test_decoder_equals_the_codec(tokens):
    decoder, rng = bytepair.Decoder(tokens), random.Random(6)
    hard = [k for k, t in enumerate(tokens) if t[-1] >= 0x80]
    for _ in range(6000):
        ids = [rng.choice(hard) if rng.random() < 0.6 else rng.randrange(256) for _ in range(rng.randint(0, 9))]
        cut = rng.randint(0, len(ids))
        assert decoder.push(ids[:cut]) + decoder.push(ids[cut:]) + decoder.close() == b"".join(tokens[k] for k in ids).decode("utf-8", "replace")


def test_whole_texts(spark, library, monkeypatch):
    rng = random.Random(8)
    signs = [chr(c) for c in (*range(0x20, 0x7F), 0x1C, 0x85, 0xA0, 0x2028, 0x3000, 0x300, 0xE9, 0x4E2D, 0x1F600, 0x558, 0x10EE7, 0x2CEA7, 0x11DE0, 0x378)] + ["\n", "\r", "\t", "'s", " the", "  ", "123", "été"]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(400)]
    texts += [None, "", " ", "a" * 30_000, " " * 9_000, "word " * 20_000, "".join(rng.choices("abcdefgh", k=20_000)), texts[0], texts[0]]
    frame = spark.createDataFrame([(k, t, "own", 1) for k, t in enumerate(texts)] + [(None, "no id", None, None), (None, None, None, None)], SCHEMA).repartition(3)
    monkeypatch.setattr(bytepair, "IDS", 5_000)
    encoded = bytepair.encode(frame, PATH, public_tokenizers.PATTERN)
    assert encoded.columns == ["doc_id", "n_tokens", "ids"]
    got = {r["doc_id"]: (r["ids"], r["text"]) for r in encoded.select("*", F.col("ids").alias("kept")).transform(lambda d: bytepair.decode(d, PATH)).withColumnRenamed("kept", "ids").collect()}
    assert {k: v for k, v in got.items() if k is not None} == {k: (library.encode_ordinary(t or ""), t or "") for k, t in enumerate(texts)}
    assert encoded.where("doc_id is null").count() == 2 and encoded.limit(0).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [5, None, -3, 10**7])], "k int, ids array<int>")
    assert {r["k"]: r["text"] for r in bytepair.decode(odd, PATH).collect()} == {1: "", 2: library.decode([5])}


def test_query(spark, library):
    rows = {r["doc_id"]: r for r in bytepair.op11_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for d in docs:
        ids, r = library.encode_ordinary(d["text"] or ""), rows[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((d["text"] or "").encode()))
    assert len(rows) == len(docs)
