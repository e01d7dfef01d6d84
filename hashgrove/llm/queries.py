"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hashgrove.llm import decontamination, langid, mixing, ngram_join, pii, secrets, sharding, spots, substrings, toxicity
from hashgrove.llm.shared import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": lambda spark, d: pii.digest(documents(spark, d)),
    "op2_decontamination": lambda spark, d: decontamination.leaks(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
    "op3_substring_dedup": lambda spark, d: substrings.digest(documents(spark, d)),
    "op4_toxicity": lambda spark, d: toxicity.digest(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "op5_spotsigs": lambda spark, d: spots.digest(documents(spark, d)),
    "op6_secrets": lambda spark, d: secrets.digest(documents(spark, d)),
    "op7_mixing": lambda spark, d: mixing.digest(documents(spark, d)),
    "op8_sharding": lambda spark, d: sharding.digest(documents(spark, d)),
    "op9_langid": lambda spark, d: langid.digest(documents(spark, d)),
    "op10_ngram_join": lambda spark, d: ngram_join.digest(documents(spark, d)),
}

ORACLES: dict[str, str] = {
    "op1_pii": pii.oracle(),
    "op3_substring_dedup": substrings.oracle(),
    "op7_mixing": mixing.oracle(),
    "op10_ngram_join": ngram_join.oracle(),
}
