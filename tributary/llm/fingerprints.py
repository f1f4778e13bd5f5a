"""Document fingerprints by one-permutation MinHash with optimal densification (operator 2), native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.shared import BROADCAST_ROWS, documents

BINS = 128
BITS = 4
SHINGLE = 5
_EMPTY = (1 << 52) - 1  # above every shingle's value


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _paired(a: Column, b: Column, by: int) -> Column:
    n = F.greatest(F.size(b) - by, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, by + 1, n), lambda x, y: F.xxhash64(x, y))


def shingle_steps(words: str, into: str, size: int = SHINGLE) -> list[tuple[str, Column]]:
    """Columns that hash each run of `size` words (of all words if there are fewer), by doubling: a
    run of a + b is a run of a and one of b after it."""
    steps, runs, length = [], words, 1
    for k, bit in enumerate(bin(size)[3:]):
        steps.append((f"{into}_{k}", _paired(F.col(runs), F.col(runs), length)))
        runs, length = f"{into}_{k}", 2 * length
        if bit == "1":
            steps.append((f"{into}_{k}w", _paired(F.col(runs), F.col(words), length)))
            runs, length = f"{into}_{k}w", length + 1
    whole = F.array(F.xxhash64(F.array_join(F.transform(F.col(words), lambda h: h.cast("string")), " ")))
    steps.append((into, F.when(F.size(words) >= size, F.col(runs)).when(F.size(words) > 0, whole).otherwise(F.array().cast("array<bigint>"))))
    return steps


def in_bins(hashes: Column, bins: int = BINS) -> Column:
    """One permutation: hashes sorted by bin, with a bound for every bin (_EMPTY) among them."""
    code = F.transform(hashes, lambda h: F.shiftleft(h.bitwiseAND(F.lit(bins - 1)), 52) + F.shiftrightunsigned(h, 13))
    bounds = F.array(*[F.lit(j << 52 | _EMPTY).cast("long") for j in range(bins)])
    return F.sort_array(F.concat(code, bounds))


def bin_minima(ordered: Column) -> Column:
    """The first value of each bin's run: one a bin, in order, _EMPTY where no shingle fell."""
    before = F.concat(F.array(F.lit(-1).cast("long")), F.slice(ordered, 1, F.size(ordered) - 1))
    first = F.zip_with(ordered, before, lambda x, p: F.when(F.shiftright(x, 52) != F.shiftright(p, 52), x.bitwiseAND(F.lit(_EMPTY))))
    return F.filter(first, lambda x: x.isNotNull())


def densified(minima: Column, bins: int = BINS) -> Column:
    """Fill each empty bin from the first full one of its own probe sequence.

    Bin j probes (37 j + 11 + t b_j) mod bins with odd b_j for t = 1, 2, ...: a fixed pseudo-random
    order of all bins that is the same for every document; few probes are read before the rest
    are. All stay empty if there is no full one.
    """

    def found(j: Column, first: int, last: int) -> Column:
        probe = lambda t: F.element_at(minima, ((j * 37 + 11 + t * (2 * ((j * 53 + 29) % bins) + 1)) % bins + 1).cast("int"))
        return F.get(F.filter(F.transform(F.array(*map(F.lit, range(first, last + 1))), probe), lambda v: v != _EMPTY), F.lit(0))

    return F.transform(minima, lambda v, j: F.when(v != _EMPTY, v).otherwise(F.coalesce(found(j, 1, 4), found(j, 5, 24), found(j, 25, bins))))


def low_bits(full: Column, bits: int = BITS) -> Column:
    return F.transform(full, lambda v: v.bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))


def packed(digits: Column) -> Column:
    """Four low-order bits a bin as one hexadecimal digit each; empty if there are no shingles."""
    return F.when(F.element_at(digits, 1).isNull(), "").otherwise(F.lower(F.array_join(F.transform(digits, lambda d: F.hex(d)), "")))


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated similarity: the share of equal digits, less what chance alone makes equal."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda e: e)) / bins
    none = lambda d: F.element_at(d, 1).isNull()
    return F.when(none(a) != none(b), 0.0).otherwise(F.greatest(F.lit(0.0), (same - 2.0**-bits) / (1 - 2.0**-bits)))


def fingerprinted(docs: DataFrame, text: str, into: str, bins: int = BINS) -> DataFrame:
    """Adds `into`: an array with one packed digit a bin (nulls if the text has no words).

    Each step is a column of its own, so that no expression is evaluated within another's lambda.
    """
    name = lambda x: f"{into}_{x}"
    steps = [(name("words"), word_hashes(F.col(text))), *shingle_steps(name("words"), name("shingles"))]
    steps += [(name("ordered"), in_bins(F.col(name("shingles")), bins)), (name("minima"), bin_minima(F.col(name("ordered")))), (name("full"), densified(F.col(name("minima")), bins))]
    for step, column in steps:
        docs = docs.withColumn(step, column)
    return docs.withColumn(into, low_bits(F.col(name("full")))).drop(*[step for step, _ in steps])


def with_next(docs: DataFrame, rows: int = 2000) -> tuple[DataFrame, Window]:
    """Deals documents into ranges of doc_id of about `rows`, each with the first row of the next
    range (after the last: the first) as a guest, and gives the window that orders a range.

    Ranges are quantile segments of doc_id (256 at most), each cut evenly.
    """
    at = docs.select(F.coalesce("doc_id", F.lit(-(1 << 62))).alias("o"))
    n = at.count()
    segments = max(1, min(256, n // rows))
    bounds = at.agg(F.percentile_approx("o", [k / segments for k in range(segments + 1)], 10_000)).first()[0] or [0]
    parts = max(1, n // (rows * segments))
    low = F.array(*map(F.lit, bounds))
    segment = F.greatest(F.size(F.filter(low, lambda b: b <= F.col("o"))), F.lit(1)).cast("long")
    lo, hi = F.element_at(low, segment.cast("int")), F.coalesce(F.try_element_at(low, (segment + 1).cast("int")), F.lit(bounds[-1] + 1))
    within = F.floor((F.col("o") - lo) * F.lit(float(parts)) / F.greatest(hi - lo, F.lit(1)))
    dealt = docs.withColumn("o", F.coalesce("doc_id", F.lit(-(1 << 62)))).withColumn("key", F.xxhash64("text"))
    dealt = dealt.withColumn("range", segment * parts + F.greatest(F.least(within, F.lit(parts - 1)), F.lit(0)).cast("long"))
    first = dealt.groupBy("range").agg(F.min(F.struct("o", "key")).alias("first"))  # a row a range
    first = first.withColumn("segment", F.floor(F.col("range") / parts))
    every = Window.partitionBy(F.lit(0))  # over segments, of which there are few
    before = first.groupBy("segment").agg(F.max("range").alias("last"))
    before = before.select("segment", F.coalesce(F.lag("last").over(every.orderBy("segment")), F.max("last").over(every)).alias("before"))
    host = F.coalesce(F.lag("range").over(Window.partitionBy("segment").orderBy("range")), F.col("before"))
    ends = first.join(F.broadcast(before), "segment").select(host.alias("host"), F.col("first.o").alias("o"), F.col("first.key").alias("key"))  # 257 rows at most
    if segments * parts <= BROADCAST_ROWS:
        ends = F.broadcast(ends)  # a row a range; more are joined by shuffle
    guests = dealt.drop("range").join(ends, ["o", "key"]).dropDuplicates(["o", "key"]).withColumn("range", F.col("host")).drop("host")
    both = dealt.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1)))
    return both, Window.partitionBy("range").orderBy("guest", "o", "key")


def fingerprint_documents(docs: DataFrame, rows: int = 2000) -> DataFrame:
    """Fingerprint every whole text and its edited text: its last quarter of code points replaced
    by the first as many (or all) of the next document by doc_id, after the last the first.

    Shingles are SHINGLE words (all words, if fewer). Gives per row doc_id, n_chars, edited (text),
    digits, edited_digits, fingerprint, edited_fingerprint (BINS hexadecimal digits, "" without
    words), near_edited and near_next (estimated similarity, 0 to 1; two texts without words are
    alike). Null text counts as empty; null doc_ids come first; of rows with equal doc_id a hash of
    the text decides the order, and rows that repeat have equal fingerprints; other columns are
    ignored; an empty table gives none. A task holds the documents of a few ranges, sorted.
    """
    both, window = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), rows)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    at = both.withColumn("after", F.lead("text").over(window)).withColumn("n_chars", n.cast("long"))
    at = at.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("after", F.lit("")), F.lit(1), cut)))
    at = fingerprinted(fingerprinted(at.drop("after"), "text", "digits"), "edited", "edited_digits").drop("text")
    at = at.withColumn("next_digits", F.lead("digits").over(window)).where("guest = 0")
    return at.select("doc_id", "n_chars", "edited", "digits", "edited_digits", packed(F.col("digits")).alias("fingerprint"), packed(F.col("edited_digits")).alias("edited_fingerprint"), likeness(F.col("digits"), F.col("edited_digits")).alias("near_edited"), likeness(F.col("digits"), F.col("next_digits")).alias("near_next"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fingerprint_documents(documents(spark, sf_dir))
    return done.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
