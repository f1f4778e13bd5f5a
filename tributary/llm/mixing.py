"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 4), native.

All words are cut into equal blocks. The blocks are apportioned to the sources by highest quotients
of their targets, a source's blocks to its shards by highest quotients of the shards' words. A
shard's documents, in seeded order, are one stream of words cut into blocks; whole rounds of the
stream are taken as far as the shard's quota goes, then blocks in a seeded order of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.shared import WORD, documents, stage

#: Fixed by the contract: weights by the sources' order, and how often a document may be taken.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Most sources whose rows (some 60 bytes each) are broadcast.
SOURCES_SENT = 100_000
#: Words of a block.
BLOCK = 32
#: Places of a shard's blocks in seeded order are below it.
PRIME = 2**31 - 1


def sainte_lague(shares: DataFrame, group: str, key: str, share: str, seats: str) -> DataFrame:
    """Seats of each key by the highest quotients share / (2 k + 1) within its group.

    All but about two seats for each key are known from rounding: x (n - s/2) / n + 1/2 and
    x (n + s/2) / n + 1/2 of the ideal x bound a key's seats, n being the group's seats and s its
    keys. Only the seats between the bounds become rows and are ranked by quotient; ties go to the
    smaller key. Adds column `quota`; keys without a share get none.
    """
    whole = Window.partitionBy(group)
    ideal = F.col(seats) * F.col(share) / F.sum(share).over(whole)
    at = shares.withColumn("_ideal", F.when(F.sum(share).over(whole) > 0, ideal).otherwise(0.0)).withColumn("_keys", F.count("*").over(whole))
    bound = lambda d: F.floor(F.col("_ideal") * (F.col(seats) + d * F.col("_keys") / 2) / F.greatest(F.col(seats), F.lit(1)) + 0.5)
    at = at.withColumn("_low", F.greatest(bound(-1), F.lit(0))).withColumn("_high", F.greatest(bound(1) + 1, F.col("_low") + 1))
    at = at.withColumn("_left", F.col(seats) - F.sum("_low").over(whole))
    seat = at.where("_ideal > 0").select(group, key, "_left", share, F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_seat"))
    best = Window.partitionBy(group).orderBy(F.desc(F.col(share) / (2 * F.col("_seat") + 1)), key)
    more = seat.withColumn("_place", F.row_number().over(best)).where("_place <= _left").groupBy(group, key).agg(F.count("*").alias("_more"))
    return at.join(more, [group, key], "left").withColumn("quota", F.col("_low") + F.coalesce("_more", F.lit(0))).drop("_ideal", "_keys", "_low", "_high", "_left", "_more")


def targets(sources: DataFrame) -> DataFrame:
    """Adds place, weight and target to source, source_size.

    Weights go by the sources' order of code points, null last. A target stops at MOST_COPIES
    times its source's size; the excess is shared anew by weight. Sources in the order of size per
    weight stop first, so one pass finds the last that does.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    at = sources.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int")))
    at = at.withColumn("cap", MOST_COPIES * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "place")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    at = at.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    open_ = F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "place", "level"))
    at = at.withColumn("water", F.min(open_).over(every)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap").cast("double")))
    return at.select("source", "source_size", "docs", "place", target.alias("target"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _turn(*parts: Column) -> Column:
    """A 60-bit number of the md5 of the parts, which any engine repeats."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _place(b: Column) -> Column:
    """A block's place in its shard's seeded order: a congruence, so no two blocks share one."""
    return (b * F.col("factor") + F.col("offset")) % PRIME


def _picked(block: int) -> Column:
    """A document's words in the picked blocks of its shard, as ranges in the document."""
    span = lambda b: F.struct((F.greatest(b * block, F.col("before")) - F.col("before")).alias("start"), (F.least((b + 1) * block, F.col("before") + F.col("size")) - F.col("before")).alias("end"))
    every = F.sequence(F.floor(F.col("before") / block), F.floor((F.col("before") + F.col("size") - 1) / block))
    hit = F.filter(every, lambda b: (b < F.col("full")) & (_place(b) <= F.col("last")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.when((F.col("size") > 0) & F.col("last").isNotNull(), F.transform(hit, span)).otherwise(none)


def mix_sources(docs: DataFrame, block: int = BLOCK, seed: int = 1, carry: bool = False) -> DataFrame:
    """Take from every source about its target number of words, and say how many of each document.

    A source's documents are dealt, by a seeded hash of doc_id, over about as many shards as a
    shard has documents (the root of their number), so that neither a shard nor the list of a
    source's shards is large. A shard takes all its words as often as its quota allows, then as
    many of its full blocks as fill the rest, least hash first. No document is taken more than
    MOST_COPIES times; runs agree. A source's taken words differ from its target by a few blocks.

    Gives per row doc_id, source, size, source_size, target, taken, copies (whole ones) and picked
    (ranges of words, from 0, of a last, partial copy), with `carry` also `row`, the input's row.
    Null text has size 0 and is never taken; a null source is a source, last in order, a null doc_id
    a doc_id; rows that repeat count each, ties among them fall either way; other columns are
    ignored; an empty table gives none. Windows hold one shard, one source's shards, or one row a
    source (the list of sources is in one place: the water level needs all of them).
    """
    columns = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("key"), _turn(F.lit(seed), F.col("doc_id")).alias("turn"), *columns)
    sized = stage(rows.drop("row"), "sizes")
    source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    source = source.withColumn("all", F.lit(0)).withColumn("blocks", F.round(F.sum("source_size").over(Window.partitionBy("all")) / block).cast("long"))
    source = sainte_lague(source, "all", "place", "target", "blocks").select("source", "source_size", "target", "place", "quota", F.ceil(F.sqrt("docs")).alias("shards"))
    source = stage(source, "sources")
    if source.count() <= SOURCES_SENT:
        source = F.broadcast(source)  # a row a source; with more sources the join shuffles

    def deal(df: DataFrame) -> DataFrame:
        met = df.alias("d").join(source.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        return met.select("d.*", "source_size", "target", "place", "quota", F.pmod("turn", "shards").alias("shard"))

    shard = deal(sized).groupBy("place", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("seats"))
    shard = sainte_lague(shard, "place", "shard", "words", "seats").where("words > 0")
    shard = shard.select("place", "shard", "words", F.least(F.col("quota") * block, MOST_COPIES * F.col("words")).alias("take"))
    shard = shard.withColumn("copies", F.floor(F.col("take") / F.col("words"))).withColumn("full", F.floor(F.col("words") / block))
    shard = shard.withColumn("picks", F.least("full", F.floor((F.col("take") - F.col("copies") * F.col("words")) / block + 0.5)))
    number = lambda what: _turn(F.lit(seed), F.col("place"), F.col("shard"), F.lit(what))
    shard = stage(shard.withColumn("factor", number("factor") % (PRIME - 1) + 1).withColumn("offset", number("offset") % PRIME), "shards")
    blocks = shard.where("picks > 0").select("place", "shard", "picks", "factor", "offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("b"))
    order = F.row_number().over(Window.partitionBy("place", "shard").orderBy("at"))
    last = blocks.withColumn("at", _place(F.col("b"))).withColumn("k", order).where("k = picks").select("place", "shard", F.col("at").alias("last"))
    shard = shard.join(last, ["place", "shard"], "left").drop("take", "picks", "words")

    before = F.sum("size").over(Window.partitionBy("place", "shard").orderBy("turn", "doc_id", "key").rowsBetween(Window.unboundedPreceding, -1))
    at = deal(rows if carry else sized).withColumn("before", F.coalesce(before, F.lit(0)))
    at = at.join(shard, ["place", "shard"], "left").withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(0).cast("long"))
    at = at.withColumn("picked", _picked(block))
    rest = F.aggregate("picked", F.lit(0).cast("long"), lambda n, p: n + p["end"] - p["start"])
    return at.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size") + rest).alias("taken"), "copies", "picked", *(["row"] if carry else []))


def materialise(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents with the columns of `docs`: as many whole copies as were taken, then one
    of the words of the picked blocks, joined by one space; documents of which nothing is taken are
    left out. Each row's words are those taken of it, also where rows repeat. Only null texts and
    empty ones are never taken."""
    mixed = mix_sources(docs, carry=True, **how)
    every = F.filter(F.sequence(F.lit(1).cast("long"), F.col("copies") + 1), lambda c: (c <= F.col("copies")) | (F.size("picked") > 0))
    mixed = mixed.select("row", "copies", "picked", F.explode(every).alias("copy"))
    words = F.filter(F.split(F.col("row.text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    parts = lambda own: F.flatten(F.transform("picked", lambda p: F.slice(own, p["start"].cast("int") + 1, (p["end"] - p["start"]).cast("int"))))
    some = F.array_join(F.transform(F.array(words), parts)[0], " ")  # words are told once a text
    mixed = mixed.withColumn("text", F.when(F.col("copy") > F.col("copies"), some).otherwise(F.col("row.text")))
    own = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return mixed.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def _quota(rows: str, group: str, key: str, share: str, seats: str) -> str:
    """SQL: seats by highest quotients, each one a row."""
    return f"""select {group}, {key}, count(*) as quota from (
  select *, row_number() over (partition by {group} order by {share} / (2 * seat + 1) desc, {key}) as place_
  from (select *, unnest(range(cast({seats} as bigint))) as seat from {rows} where {share} > 0) q) r where place_ <= {seats} group by 1, 2"""


_HASH = "cast(concat('0x', substr(md5({}), 1, 15)) as bigint)"
_WEIGHT = "case (place - 1) % 3 when 0 then 5 when 1 then 2 else 1 end"
#: Every seat and every block is a row here; the weights, copies and BLOCK are those of the operator.
OP4_SQL = f"""with sized as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
  {_HASH.format("concat('1:', coalesce(cast(doc_id as varchar), ''))")} as turn from documents),
sources as (select source, cast(sum(size) as bigint) as source_size, count(*) as docs, row_number() over (order by source nulls last) as place from sized group by source),
weighted as (select *, {_WEIGHT} as weight, {MOST_COPIES} * source_size as cap from sources),
levels as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by cap / weight, place rows between current row and unbounded following) as level from weighted),
water as (select (select level from levels where cap / weight > level order by cap / weight, place limit 1) as water),
aimed as (select l.*, least(cast(cap as double), coalesce(water * weight, cap)) as target, cast(round((select sum(source_size) from sources) / {BLOCK}) as bigint) as blocks, 0 as everything from levels l, water),
seats as ({_quota("aimed", "everything", "place", "target", "blocks")}),
dealt as (select d.*, s.place, s.source_size, s.target, coalesce(q.quota, 0) as quota, d.turn % cast(ceil(sqrt(s.docs)) as bigint) as shard
  from sized d join aimed s on d.source is not distinct from s.source left join seats q on q.place = s.place),
shards as (select place, shard, cast(sum(size) as bigint) as words, max(quota) as seats from dealt group by 1, 2),
won as ({_quota("shards", "place", "shard", "words", "seats")}),
plan as (select s.place, s.shard, words, least(coalesce(quota, 0) * {BLOCK}, {MOST_COPIES} * words) as take from shards s left join won w on w.place = s.place and w.shard = s.shard where words > 0),
picks as (select *, take // words as copies, words // {BLOCK} as full_, least(words // {BLOCK}, cast(floor((take - take // words * words) / {BLOCK} + 0.5) as bigint)) as n_picks from plan),
seeds as (select *, {_HASH.format("concat('1:', place, ':', shard, ':factor')")} % {PRIME - 1} + 1 as factor, {_HASH.format("concat('1:', place, ':', shard, ':offset')")} % {PRIME} as offset_ from picks),
picked as (select place, shard, b from (select *, row_number() over (partition by place, shard order by (b * factor + offset_) % {PRIME}) as k
  from (select *, unnest(range(full_)) as b from seeds) x) y where k <= n_picks),
placed as (select *, coalesce(sum(size) over (partition by place, shard order by turn, doc_id rows between unbounded preceding and 1 preceding), 0) as before_ from dealt),
got as (select d.doc_id, sum(least(d.before_ + d.size, (p.b + 1) * {BLOCK}) - greatest(d.before_, p.b * {BLOCK})) as n
  from placed d join picked p on p.place = d.place and p.shard = d.shard and p.b * {BLOCK} < d.before_ + d.size and (p.b + 1) * {BLOCK} > d.before_ group by 1)
select d.doc_id, d.size, d.source_size, d.target, cast(case when d.size > 0 then p.copies * d.size + coalesce(g.n, 0) else 0 end as bigint) as taken
from placed d left join picks p on p.place = d.place and p.shard = d.shard left join got g on g.doc_id = d.doc_id"""
