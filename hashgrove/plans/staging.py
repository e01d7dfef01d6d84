"""Cutting lineage between the rounds of a loop: a table in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a folder of our own on a local master; on a cluster, whose
    machines share no local folder, an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="hashgrove-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Folders of written rounds, so that ``release`` can delete them.
WRITTEN: list[str] = []


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete all rounds written so far. To be called when no frame made from them is read any more."""
    while WRITTEN:
        delete_folder(spark, WRITTEN.pop())


def cut(df: DataFrame) -> DataFrame:
    """Write df under the shared folder and read it back."""
    return counted_cut(df)[0]


def counted_cut(df: DataFrame, what: str | None = None) -> tuple[DataFrame, int]:
    """cut(df) and its number of rows, or of those where ``what`` holds, counted while it is written."""
    spark, seen = df.sparkSession, Observation()
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.observe(seen, F.count("*" if what is None else F.when(F.expr(what), 1)).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]
