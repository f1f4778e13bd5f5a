"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame;
all but the last return the columns of `documents`. In every stage a null doc_id, lang, source or
n_chars is a value like others and a null text counts as empty; columns besides those of `documents`
are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import mixing, near_dedup, packing, shared, suffix_dedup, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", shared.text_key(F.col("text")))


def unique(docs: DataFrame) -> DataFrame:
    """One row of each equal (doc_id, text); only the rows that repeat are moved."""
    docs = _keyed(docs)
    again = docs.groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key")
    again = shared.stage(again, "again")
    if again.count() <= shared.BROADCAST_ROWS:
        again = F.broadcast(again)  # two longs a row; a larger set is joined by shuffle
    repeated = shared.matched(docs, again, "left_semi").dropDuplicates(["doc_id", "text"])
    return shared.matched(docs, again, "left_anti").unionByName(repeated).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learned from the labels, predicts to be toxic go.

    Null and empty texts have nothing that could match and stay; repeated rows are judged each,
    alike; labels with a null doc_id or a null mark teach nothing.
    """
    grammar = toxicity.learn(docs, shared.table(spark, sf_dir, "labels"))
    return toxicity.emit(docs, grammar, "text", "lang", "source", "n_chars").where("score < 0.3").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays: the least doc_id.

    Of rows equal in doc_id and text one stays, all other columns its own; different texts of one
    doc_id are one document and stay or go together; documents without a doc_id have no near copies
    and stay, and so do texts without a word.
    """
    docs = unique(docs)
    found = near_dedup.near_duplicates(docs, shingle=5, percent=80)
    kept = found.where("kept").select("doc_id").distinct()
    return docs.join(kept.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 200 that stand anywhere else go; documents left without a word go too, so
    null, empty and blank texts do.

    Rows equal in doc_id and text count as one; two texts of one doc_id are two documents. Bytes that
    no longer form a character go with what was cut; n_chars is counted anew.
    """
    docs = unique(docs)
    done = suffix_dedup.suffix_array_dedup(docs)
    text = suffix_dedup.kept_text(F.col("kept"))
    left = shared.matched(_keyed(docs).select("doc_id", "key", "lang", "source"), done.select("doc_id", "key", text.alias("text")), "inner")
    return left.where(mixing.word_count(F.col("text")) > 0).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; n_chars is counted anew.

    Documents of which nothing is taken are left out, texts without a word always; repeated rows are
    taken each for itself; a null source is a source.
    """
    return mixing.materialise(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two sequences of token ids; a null or empty text would be one sequence of its end alone,
    repeated rows are packed each, a null doc_id stays null."""
    return packing.pack_powers_of_two(docs, packing.tokenizer_file())


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("suffix_dedup", drop_repeats), ("mixing", mix), ("packing", pack)]
#: SQL can express neither the grammar nor the tokenizer; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = shared.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
