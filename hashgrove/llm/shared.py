"""Tables written to the cluster's shared folder, to cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashgrove.plans.staging import WRITTEN, delete_folder, shared_folder


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a folder of our own on a local master (tests); on a cluster, an error."""
    return shared_folder(spark)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    path = getattr(df, "_staged_path", None)
    if path:
        delete_folder(df.sparkSession, path)
        if path in WRITTEN:
            WRITTEN.remove(path)


#: Rows of one Arrow batch of texts: what a Python worker holds at once stays small beside the executor's memory.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS, if it is larger, before texts go to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bits of an id filter: the fixed bound of what ``may_hold`` broadcasts, at most a row for each 64.
FILTER_BITS = 1 << 23


def may_hold(docs: DataFrame, key: Column, ids: DataFrame, id_: Column, stage: bool = True) -> DataFrame:
    """docs with a boolean ``__may``: false only if its key is surely not among ids.

    A bitmap of FILTER_BITS hashed ids, folded by bit_or on the executors, is broadcast; its size does not grow with
    the input. It keeps texts that a join would drop out of the shuffle, and decides nothing else. ``stage`` writes it first.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bit = lambda c: F.expr("shiftleft(1L, CAST(__p % 64 AS INT))")
    words = ids.select(place(id_).alias("__p")).select(F.expr("__p DIV 64").alias("__w"), bit(None).alias("__b")).groupBy("__w").agg(F.bit_or("__b").alias("__bits"))
    if stage:
        words = staged(words, "id-filter")
    out = docs.withColumn("__p", place(key)).withColumn("__w", F.expr("__p DIV 64")).join(F.broadcast(words), "__w", "left")
    return out.withColumn("__may", F.coalesce(F.col("__bits").bitwiseAND(bit(None)) != 0, F.lit(False))).drop("__p", "__w", "__bits")
