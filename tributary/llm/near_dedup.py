"""MinHash near-dedup with an LSH forest (operator 9).

1. Sets and signatures: each text's distinct shingles give two fingerprints of the set and VALUES
   minima. Texts with equal sets are one from here on (their least doc_id stands for them).
2. Forest. Orders of the signature: in each, texts are sorted by their values from one place of it on,
   so that texts with a common prefix stand together. A region is a run of neighbours whose prefixes
   are equal to the depth of the level; its texts are compared with each other, and those whose
   signatures agree in enough values are candidates. Depth adapts to the region: one of over REGION
   texts is not compared but goes a level deeper, where longer prefixes part what a template has in
   common, in as many more orders as that depth needs. Only what is still together in such a region
   at the last of DEPTHS is compared in blocks, every pair of blocks being one group of rows.
   `forest` takes the orders of each level and the values that must agree from `percent`: at every
   level a pair at that similarity shares no region with probability MISS at most, so after L levels
   with L * MISS at most, and agrees in too few values (79 of 128 are enough for 80 percent, 87 for
   85) with probability MISS at most. A text meets at most REGION others in each of a level's orders
   unless they agree with it to the last depth.
3. Confirmation. Candidates join into bundles; each bundle's whole texts go to one task, which
   follows the links from text to text on full sets, so connectivity is exact whatever the number
   of links. Bundles of over BLOCK shingles are dealt in blocks, and every pair of blocks is one
   task: no bundle is gathered in one place, and no link is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.components import connected_components
from tributary.llm.exchange import NAME, SENT, bits_back, bits_of, by_name, distinct, exchange, kept_row, numbered, rows, run_lengths, run_starts, sent_rows
from tributary.llm.names import Named, chunks, give_back, mix, words_of
from tributary.llm.shared import BROADCAST_ROWS, documents, spread, stage

#: Depths of the levels, values of a signature, and how rarely a pair at the threshold is missed in a level.
DEPTHS, VALUES, MISS = (3, 6, 12), 128, 1e-6
REGION, BLOCK = 4096, 1 << 20
#: Signatures handled at a time.
PART = 1024
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_A = mix(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(x: np.ndarray, ends: np.ndarray, size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document, concatenated, and where each document's begin."""
    x = _LOWER[x] if lower else x
    start, end, doc = words_of(x, ends)
    named = Named(Named(x).of(start, end))
    first = np.searchsorted(doc, np.arange(len(ends) + 1))
    every = named.every(size)
    at = np.flatnonzero(doc[: len(every)] == doc[size - 1 : size - 1 + len(every)])
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < size))
    name = np.concatenate([every[at], named.of(first[short], first[short + 1])])
    owner = np.concatenate([doc[at], short])
    order = np.lexsort((name, owner))
    name, owner = name[order], owner[order]
    kept = run_starts(name, owner)
    name, owner = name[kept], owner[kept]
    return name, np.searchsorted(owner, np.arange(len(ends) + 1))


def _signatures(name: np.ndarray, first: np.ndarray, full: np.ndarray) -> np.ndarray:
    """VALUES minima, 16 bits kept of each, of the documents `full`, which have shingles."""
    out = np.empty((len(full), VALUES), np.uint16)
    for k, a in enumerate(_A):
        h = name * a
        h ^= h >> np.uint64(32)
        out[:, k] = (np.minimum.reduceat(h * a, first[full]) >> np.uint64(16)).astype(np.uint16)
    return out


def _measured(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("signature", pa.binary())])

    def map_chunks(batches):
        for batch, x, ends in chunks(batches):
            name, first = shingle_sets(x, ends, size)
            count = np.diff(first)
            full = np.flatnonzero(count)
            a, b = np.zeros(len(ends), np.uint64), np.zeros(len(ends), np.uint64)
            signature = [None] * len(ends)
            if len(full):
                a[full] = mix(np.add.reduceat(mix(name), first[full]))
                b[full] = mix(np.bitwise_xor.reduceat(mix(name * _A[0]), first[full]) + np.add.reduceat(name * name, first[full]))
                for k, s in zip(full, _signatures(name, first, full)):
                    signature[k] = s.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(count, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(signature, pa.binary())], schema=schema)

    return map_chunks


def forest(percent: int) -> tuple[list[tuple[int, int]], int]:
    """(orders, depth) of each level and the number of equal values that makes a candidate, such that
    either lets a pair at `percent` through but for MISS. A level whose orders would be too many for
    the signature (more than VALUES) is left out; the first has its depth made less instead."""
    p = min(max(percent, 1), 99) / 100
    orders = lambda depth: math.ceil(math.log(MISS) / math.log1p(-(p**depth)))
    first = next((d for d in range(DEPTHS[0], 1, -1) if orders(d) * d <= VALUES), 1)
    levels = [(min(orders(first), VALUES), first)] + [(orders(d), d) for d in DEPTHS[1:] if orders(d) <= VALUES]
    below = np.cumsum([math.comb(VALUES, k) * p**k * (1 - p) ** (VALUES - k) for k in range(VALUES + 1)])
    return levels, int((below <= MISS).sum())


def _prefixes(buckets: int, trees: int, depth: int):
    def map_chunks(batches):
        number = numbered()
        for batch in batches:
            for low in range(0, batch.num_rows, PART):
                part = batch.slice(low, PART)
                signature = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, VALUES)
                names = _prefix_names(signature, trees, depth)
                chunk, found = next(number), distinct(names)[0]
                kept = kept_row(buckets, chunk, (part.column(0).to_numpy(), signature.tobytes()))
                yield rows([*sent_rows(chunk, found, by_name(found, buckets)), kept])

    return map_chunks


def _turns(trees: int, depth: int) -> np.ndarray:
    """Which values each order begins with: parts of the signature while they last, else values drawn
    anew for each order, by a fixed seed."""
    if trees * depth <= VALUES:
        return np.arange(trees)[:, None] * (VALUES // trees) + np.arange(depth)[None, :]
    return np.argsort(np.random.default_rng(depth).random((trees, VALUES)), axis=1)[:, :depth]


def _prefix_names(signature: np.ndarray, trees: int, depth: int) -> np.ndarray:
    turn = _turns(trees, depth)
    key = signature[:, turn].astype(np.uint64)
    name = np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64), key.shape[:2])
    for d in range(depth):
        name = mix(name * np.uint64(65599) + key[:, :, d])
    return name.reshape(-1)


def _shared(names: np.ndarray, cuts: np.ndarray) -> list[bytes | None]:
    _, which, count = distinct(names)
    return bits_back(count[which] > 1, cuts)


def _in_orders(buckets: int, trees: int, depth: int):
    def finish(kept, back) -> pd.DataFrame:
        ids, raw = kept
        signature = np.frombuffer(raw, np.uint16).reshape(-1, VALUES)
        names, which, count = distinct(_prefix_names(signature, trees, depth))
        at = np.flatnonzero((bits_of(back, by_name(names, buckets)) | (count > 1))[which])
        doc = at // trees
        return pd.DataFrame({"region": names[which[at]].view(np.int64), "id": ids[doc], "signature": [s.tobytes() for s in signature[doc]]})

    return finish


def _linked(similar, n: int) -> list[tuple[int, int]]:
    """Spanning links of n things: similar(i, rest) tells which of the indexes `rest` are like i."""
    rest, links = np.arange(n), []
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            hit = similar(i, rest)
            links += [(i, int(j)) for j in rest[hit]]
            todo += rest[hit].tolist()
            rest = rest[~hit]
    return links


def _in_blocks(flagged: DataFrame, large: DataFrame) -> DataFrame:
    """Rows (region, x, y, block, id, signature): each text once for every pair of blocks it is in."""
    dealt = flagged.join(large, "region", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.select("region", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "signature")


def _agreeing(key: np.ndarray, block: np.ndarray, agree: int) -> list[tuple[int, int]]:
    """Spanning links of texts of one block, or between the texts of two blocks."""
    two = block[0] != block[-1]

    def similar(i: int, rest: np.ndarray) -> np.ndarray:
        equal = np.packbits(key[rest] == key[i], axis=1).view(np.uint64)
        hit = np.bitwise_count(equal).sum(1) >= agree
        return hit & (block[rest] != block[i]) if two else hit

    return _linked(similar, len(key))


def _candidates(agree: int):
    """Candidate links of rows of `_in_blocks`, sorted by region, x, y and block."""

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(held)
        region, x, y, block, ids = (table.column(c).to_numpy() for c in ("region", "x", "y", "block", "id"))
        key = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, VALUES)
        first, found = run_starts(region, x, y), []
        for a, n in zip(first, run_lengths(first, len(ids))):
            if n > 1 and (x[a] == y[a] or block[a] != block[a + n - 1]):
                found += [(a + i, a + j) for i, j in _agreeing(key[a : a + n], block[a : a + n], agree)]
        if not found:
            return None
        at = np.unique(ids[np.array(found)], axis=0)
        return pa.RecordBatch.from_pydict({"a": at[:, 0], "b": at[:, 1]})

    def map_chunks(batches):
        held, last = [], None  # the rows of the group that goes on
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("region", "x", "y")]
            first = run_starts(*columns)
            if not len(first):
                continue
            own = tuple(c[0] for c in columns)
            if held and own != last:
                if (out := links(held)) is not None:
                    yield out
                held = []
            if cut := first[-1]:
                held.append(batch.slice(0, cut))
                if (out := links(held)) is not None:
                    yield out
                held = []
            held.append(batch.slice(cut))
            last = tuple(c[-1] for c in columns)
        if held and (out := links(held)) is not None:
            yield out
        give_back()

    return map_chunks


def _confirmed(size: int, percent: int):
    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["doc_id"].to_numpy()
        text = [t.encode() for t in pdf["text"]]
        name, first = shingle_sets(np.frombuffer(b"".join(text), np.uint8), np.cumsum([len(t) for t in text]), size)
        count = np.diff(first)
        _, word = np.unique(name, return_inverse=True)
        held = np.zeros(word.max() + 1 if len(word) else 1, bool)

        def similar(i: int, rest: np.ndarray) -> np.ndarray:
            own = word[first[i] : first[i + 1]]
            held[own] = True
            near = rest[(100 * np.minimum(count[rest], count[i]) >= percent * np.maximum(count[rest], count[i])) & (count[rest] > 0)]
            both = np.array([held[word[first[j] : first[j + 1]]].sum() for j in near], np.int64)
            held[own] = False
            hit = np.isin(rest, near[100 * both >= percent * (count[near] + count[i] - both)]) if count[i] else np.zeros(len(rest), bool)
            return hit

        links = _linked(similar, len(ids))
        del text, name, first, word, held
        give_back()
        return pd.DataFrame({"a": [ids[i] for i, _ in links], "b": [ids[j] for _, j in links]}, dtype="int64")

    return confirm


def _forest_links(texts: DataFrame, buckets: int, levels: list[tuple[int, int]], agree: int) -> DataFrame:
    """Candidate links (a, b) of texts (doc_id, signature), level by level."""
    found = None
    for k, (trees, depth) in enumerate(levels):
        flagged = exchange(texts.mapInArrow(_prefixes(buckets, trees, depth), SENT), buckets, NAME, _shared, _in_orders(buckets, trees, depth), "region long, id long, signature binary")
        flagged = stage(flagged, "orders")
        large = flagged.groupBy("region").count().where(F.col("count") > REGION).select("region", F.ceil(F.col("count") / REGION).alias("blocks"))
        large = stage(large, "regions")
        n_large, last = large.count(), k + 1 == len(levels)
        sent = F.broadcast(large) if n_large <= BROADCAST_ROWS else large  # two longs for each large region; more are joined by shuffle
        compared = _in_blocks(flagged if last else flagged.join(sent, "region", "left_anti"), sent if last else sent.limit(0))
        compared = compared.repartition("region", "x", "y").sortWithinPartitions("region", "x", "y", "block")
        links = compared.mapInArrow(_candidates(agree), "a long, b long")
        found = links if found is None else found.unionByName(links)
        if last or not n_large:
            return found
        texts = stage(flagged.join(sent, "region", "left_semi").select(F.col("id").alias("doc_id"), "signature").dropDuplicates(["doc_id"]), "deeper")


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85) -> DataFrame:
    """Link documents with 100 |A and B| >= percent |A or B| of their shingle sets, and say what
    each document can reach.

    A-Z are lower-cased; words are runs of anything but ASCII white space; a set holds the
    distinct runs of `shingle` words, or the whole sequence if there are fewer. Gives per row
    doc_id, n_shingles, component_id (least doc_id reachable, itself included) and kept (doc_id is
    component_id). Null, empty and blank texts have no set and are linked with nothing; texts with
    equal sets are linked; rows with equal doc_id are one node (text decides for each row's
    n_shingles, any of their links counts); a null doc_id has a null component and is kept; other
    columns are ignored; an empty table gives none. Links are confirmed on full sets.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    buckets, (levels, agree) = spread(docs.sparkSession, docs), forest(percent)
    sets = stage(docs.mapInArrow(_measured(shingle), "doc_id long, n_shingles long, set_a long, set_b long, signature binary"), "sets")
    known = sets.where("n_shingles > 0 and doc_id is not null")
    same = stage(known.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("rep")), "same")
    members = known.select("doc_id", "n_shingles", "set_a", "set_b").join(same, ["n_shingles", "set_a", "set_b"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    reps = known.join(same.withColumnRenamed("rep", "doc_id"), ["doc_id", "n_shingles", "set_a", "set_b"]).select("doc_id", "signature", "n_shingles").dropDuplicates(["doc_id"])
    bundles = connected_components(_forest_links(reps.select("doc_id", "signature"), buckets, levels, agree))
    sized = bundles.join(known.groupBy("doc_id").agg(F.max("n_shingles").alias("n")).withColumnRenamed("doc_id", "id"), "id")
    blocks = sized.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    task = stage(sized.join(blocks, "component").select("id", "component", "blocks", F.pmod(F.xxhash64("id"), "blocks").alias("block")), "bundles")
    if task.count() <= BROADCAST_ROWS:
        task = F.broadcast(task)  # four longs a row; a larger set is joined by shuffle
    text = docs.join(task, docs["doc_id"] == task["id"]).drop("id")
    other = F.explode(F.sequence(F.lit(0), F.greatest(F.col("blocks") - 1, F.lit(0))))
    text = text.withColumn("other", other).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    text = text.groupBy("component", "x", "y").applyInPandas(_confirmed(shingle, percent), "a long, b long")
    linked = connected_components(stage(text.unionByName(members), "links"))
    return sets.select("doc_id", "n_shingles").join(linked, F.col("doc_id") == F.col("id"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


_W = r"[^\x20\x09-\x0D]+"
#: All pairs of documents that share a shingle, and every document that each can reach.
OP9_SQL = f"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') as ws from documents),
words as (select doc_id, len(ws) as n, unnest(ws) as w, generate_subscripts(ws, 1) as i from d),
runs as (select doc_id, n, i, string_agg(w, ' ') over (partition by doc_id order by i rows between current row and 2 following) as shingle from words),
sets as (select distinct doc_id, shingle from runs where i <= n - 2 or (n < 3 and i = 1)),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
met as (select a.doc_id as a, b.doc_id as b, count(*) as both_ from sets a join sets b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from met join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * both_ >= 85 * (x.n + y.n - both_)),
either_way as (select a, b from links union all select b, a from links),
reach as (select doc_id as x, doc_id as y from documents union select r.x, e.b from reach r join either_way e on r.y = e.a),
least_ as (select x, min(y) as component_id from reach group by x)
select d.doc_id, coalesce(s.n, 0) as n_shingles, l.component_id, l.component_id = d.doc_id as kept from d left join sizes s on s.doc_id = d.doc_id join least_ l on l.x = d.doc_id"""
