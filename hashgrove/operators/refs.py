"""Compare-and-set batches over refs: screening of one push, atomic veto, and replay of many."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashgrove.functions.names import branch_violation

ZERO = "0" * 40
#: Why a ref did not move, as clients print it.
FUNNY, DUPLICATE, EXISTS = "funny refname", "the same ref appears twice in this push", "the ref already exists"
VANISHED, STALE, MISSING = "the ref no longer exists", "the ref has moved since it was advertised", "missing necessary objects"
ATOMIC, UNPACKER = "atomic push failure", "n/a (unpacker error)"
STATE = ("repo_id long, name string, pos long, reason string, held string")


def screen(commands: DataFrame, refs: DataFrame, incomplete: DataFrame | None = None, unpack_failed: DataFrame | None = None) -> DataFrame:
    """commands (repo_id, push_id, pos, name, old_oid, new_oid) with ``reason``, null if accepted, against one snapshot of refs.

    Of commands of a push for one name only the first is judged; old values must match; a fast-forward is not asked for.
    A command that would point a ref at one of incomplete (repo_id, oid), whose closure lacks objects, is rejected; so is every
    command of a push of unpack_failed (repo_id, push_id), whatever else it asks.
    """
    bad = ~F.col("name").startswith("refs/") | branch_violation(F.col("name")).isNotNull()
    nth = F.row_number().over(Window.partitionBy("repo_id", "push_id", "name").orderBy("pos"))
    rows = commands.withColumn("__nth", nth).join(refs.select("repo_id", "name", F.col("oid").alias("__held")), ["repo_id", "name"], "left")
    held, old, new = F.col("__held"), F.col("old_oid"), F.col("new_oid")
    reason = (F.when(bad, FUNNY).when(F.col("__nth") > 1, DUPLICATE)
              .when((old == ZERO) & (new != ZERO), F.when(held.isNotNull(), EXISTS))
              .when(held.isNull(), VANISHED).when(held != old, STALE))
    rows = rows.withColumn("reason", reason)
    if incomplete is not None:
        rows = rows.join(incomplete.select("repo_id", F.col("oid").alias("new_oid")).distinct().withColumn("__lacks", F.lit(True)), ["repo_id", "new_oid"], "left")
        rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("__lacks"), MISSING))).drop("__lacks")
    if unpack_failed is not None:
        rows = rows.join(unpack_failed.select("repo_id", "push_id").distinct().withColumn("__failed", F.lit(True)), ["repo_id", "push_id"], "left")
        rows = rows.withColumn("reason", F.when(F.col("__failed"), UNPACKER).otherwise(F.col("reason"))).drop("__failed")
    return rows.select(*commands.columns, "reason")


def atomic(screened: DataFrame) -> DataFrame:
    """One rejection rejects its whole push: accepted commands of it fail with it."""
    any_bad = F.max(F.col("reason").isNotNull()).over(Window.partitionBy("repo_id", "push_id"))
    return screened.withColumn("reason", F.when(F.col("reason").isNull() & any_bad, ATOMIC).otherwise(F.col("reason")))


def replay(commands: DataFrame) -> DataFrame:
    """(repo_id, name, pos, reason, held) of commands applied one after another by pos; ``held`` is the ref's value after.

    Rows stream in order through a state of one value for each ref, so a hot ref needs time but no memory.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ref, held = None, None
        for pdf in batches:
            reasons, after = [], []
            for repo, name, old, new in zip(pdf.repo_id, pdf.name, pdf.old_oid, pdf.new_oid):
                if (repo, name) != ref:
                    ref, held = (repo, name), None
                reason = next_reason(held, old, new)
                if reason is None:
                    held = None if new == ZERO else new
                reasons.append(reason)
                after.append(held)
            yield pdf[["repo_id", "name", "pos"]].assign(reason=reasons, held=after)

    rows = commands.select("repo_id", "name", "pos", "old_oid", "new_oid").repartition("repo_id", "name").sortWithinPartitions("repo_id", "name", "pos")
    return rows.mapInPandas(run, STATE)


def next_reason(held: str | None, old: str, new: str) -> str | None:
    if old == ZERO and new != ZERO:
        return None if held is None else EXISTS
    return VANISHED if held is None else None if held == old else STALE


def refs_after(replayed: DataFrame) -> DataFrame:
    """The refs that a replay leaves."""
    return replayed.groupBy("repo_id", "name").agg(F.max_by(F.struct("held"), "pos").alias("last")).select("repo_id", "name", F.col("last.held").alias("oid")).where("oid IS NOT NULL")


def head_retarget(accepted: DataFrame, refs: DataFrame, heads: DataFrame) -> DataFrame:
    """(repo_id, branch) of repositories whose HEAD follows a push: they had no ref, and it gave them one branch, another than HEAD names."""
    pushed = accepted.where("startswith(name, 'refs/heads/')").groupBy("repo_id").agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n = 1")
    fresh = pushed.join(refs.select("repo_id").distinct(), "repo_id", "left_anti").join(heads.select("repo_id", "target"), "repo_id", "left")
    return fresh.where("target IS NULL OR target <> name").select("repo_id", F.expr("substr(name, 12)").alias("branch"))
