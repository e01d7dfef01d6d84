"""Resumable upkeep: what a repository's next step is, the next batch of it, and the life of import jobs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Objects of one batch of marking or sweeping, and of repacking; attempts of an import.
SWEEP_BATCH, REPACK_BATCH, ATTEMPTS = 64, 8, 3


def sweep_checkpoint(states: DataFrame, versions: DataFrame, now: str) -> DataFrame:
    """states (repo_id, phase, ref_version, started_at, completed_at, reachable, reclaimed_objects, reclaimed_chunks,
    reclaimed_bytes) as the next step finds them, for every repository of versions (repo_id, ref_version).

    Without a state, or with a complete one, a new mark begins with all totals at 0. Where refs have moved since, the mark begins
    again, but what was reclaimed and the start stay. Otherwise the state goes on.
    """
    rows = versions.select("repo_id", F.col("ref_version").alias("__now")).join(states, "repo_id", "left")
    fresh = F.col("phase").isNull() | (F.col("phase") == "complete")
    again = fresh | (F.col("ref_version") != F.col("__now"))
    kept = lambda c: F.when(fresh, F.lit(0).cast("long")).otherwise(F.col(c)).alias(c)
    return rows.select("repo_id", F.when(again, "mark").otherwise(F.col("phase")).alias("phase"), F.col("__now").alias("ref_version"), F.when(fresh, now).otherwise(F.col("started_at")).alias("started_at"),
                       F.lit(None).cast("string").alias("completed_at"), F.when(again, F.lit(0).cast("long")).otherwise(F.col("reachable")).alias("reachable"), *map(kept, ("reclaimed_objects", "reclaimed_chunks", "reclaimed_bytes")))


def repack_phase() -> Column:
    """Over (ref_version, sweep_phase, sweep_version, repack_version, repack_completed_at): waiting until a sweep of the same version is complete, then select until done, then complete."""
    swept = (F.col("sweep_phase") == "complete") & (F.col("sweep_version") == F.col("ref_version"))
    done = (F.col("repack_version") == F.col("ref_version")) & F.col("repack_completed_at").isNotNull()
    return F.when(~F.coalesce(swept, F.lit(False)), "waiting").when(F.coalesce(done, F.lit(False)), "complete").otherwise("select")


def next_step() -> Column:
    """Repack while it selects, else sweep; a repack follows once the sweep is complete."""
    return F.when(repack_phase() == "select", "repack").otherwise("sweep")


def next_batch(rows: DataFrame, cursors: DataFrame, size: int, order: str = "oid") -> DataFrame:
    """The first ``size`` rows of each repository behind its cursor (repo_id, cursor, null at the start), in order.

    The rank is bounded, so Spark keeps only so many rows a task before the shuffle.
    """
    ahead = rows.join(cursors.select("repo_id", F.col("cursor").alias("__cursor")), "repo_id", "left").where(F.col("__cursor").isNull() | (F.col(order) > F.col("__cursor")))
    return ahead.withColumn("__nth", F.row_number().over(Window.partitionBy("repo_id").orderBy(order))).where(F.col("__nth") <= size).drop("__nth", "__cursor")


def advance(batch: DataFrame, cursors: DataFrame, size: int, order: str = "oid") -> DataFrame:
    """(repo_id, cursor, complete) after a batch: the last of it, or the old one; complete where the batch was not full."""
    got = batch.groupBy("repo_id").agg(F.max(order).alias("__last"), F.count("*").alias("__n"))
    return cursors.join(got, "repo_id", "left").select("repo_id", F.coalesce("__last", "cursor").alias("cursor"), (F.coalesce("__n", F.lit(0)) < size).alias("complete"))


def sweep_totals(batches: DataFrame) -> DataFrame:
    """batches (repo_id, step, objects, chunks, bytes) with running totals of each repository by step: what a checkpoint counts."""
    so_far = Window.partitionBy("repo_id").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return batches.select("repo_id", "step", *(F.sum(c).over(so_far).alias(f"total_{c}") for c in ("objects", "chunks", "bytes")))


def import_jobs(events: DataFrame) -> DataFrame:
    """(job, attempts, state) of import jobs after their events (job, pos, event), streamed in order with one state a job.

    Events are the outcomes of what a job does next: ``imported``, ``unavailable`` (the only fault that is tried again, up to
    ATTEMPTS times), ``failed``, ``published``, ``target-gone``, ``cleaned``, and ``registry-down``, which leaves all as it is. States: running,
    imported (to be published), failed (to be cleaned up), done, removed; the last two take no event. An event out of place is passed over.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = chain.from_iterable(zip(b.job, b.event) for b in batches)
        out = []
        for job, own in groupby(stream, key=lambda r: r[0]):
            attempts, state = 0, "running"
            for _, event in own:
                if state == "running" and event in ("imported", "unavailable", "failed"):
                    attempts += 1
                    state = "imported" if event == "imported" else "running" if event == "unavailable" and attempts < ATTEMPTS else "failed"
                elif state == "imported" and event in ("published", "target-gone"):
                    state = "done" if event == "published" else "failed"
                elif state == "failed" and event == "cleaned":
                    state = "removed"
            out.append((job, attempts, state))
            if len(out) == 10_000:
                yield pd.DataFrame(out, columns=["job", "attempts", "state"])
                out = []
        yield pd.DataFrame(out, columns=["job", "attempts", "state"])

    return events.select("job", "pos", "event").repartition("job").sortWithinPartitions("job", "pos").mapInPandas(run, "job long, attempts int, state string")
