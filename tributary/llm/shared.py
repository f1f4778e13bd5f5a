"""What the operators share: the cluster's shared folder, row keys and readers."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word as the contracts write it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


@cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="tributary-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else, on one machine as in tests, an own one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_dir(spark.sparkContext.applicationId)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tributary-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch: texts are long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def spread(spark: SparkSession, df: DataFrame, times: int = 4) -> int:
    """How many buckets to deal packed records into: follows the number of input partitions.

    Also sees to it that Arrow batches of whole texts stay small, for the rest of the session: the
    setting is read when a plan runs, and only ever lowered.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return max(16, times * df.rdd.getNumPartitions())


def text_key(text: Column) -> Column:
    """With doc_id, tells rows apart; rows equal in both are interchangeable for every operator."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


#: Most rows of two longs that are broadcast (some 60 MB as a hash table).
BROADCAST_ROWS = 300_000


def matched(left: DataFrame, right: DataFrame, how: str, hint: str | None = None) -> DataFrame:
    """Join on (doc_id, key), where a null doc_id is a value like others; keeps left's two."""
    names = {"doc_id": "_doc_id", "key": "_key"}
    right = right.withColumnsRenamed(names)
    joined = left.join(right.hint(hint) if hint else right, left["doc_id"].eqNullSafe(right["_doc_id"]) & (left["key"] == right["_key"]), how)
    return joined.drop(*names.values())
