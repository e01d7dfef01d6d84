"""Changes of small state tables as functions of snapshots: upserts, compare-and-set, guarded deletes, pushes, imports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashgrove.operators.refs import ZERO, head_retarget


def upsert(current: DataFrame, updates: DataFrame, key: list[str], order: str) -> DataFrame:
    """current with updates (its columns and ``order``) by key: of several for a key that of the largest order counts."""
    own = Window.partitionBy(*key).orderBy(F.desc(order))
    last = updates.withColumn("__nth", F.row_number().over(own)).where("__nth = 1").select(*current.columns)
    return current.join(last.select(*key), key, "left_anti").unionByName(last)


def upsert_known(current: DataFrame, updates: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """(key, value) of both, where a value once known stays: current's first, then that of the least order."""
    rows = current.select(*key, value, F.lit(None).cast(updates.schema[order].dataType).alias("__o")).unionByName(updates.select(*key, value, F.col(order).alias("__o")))
    known = F.min_by(F.struct(value), F.when(F.col(value).isNotNull(), F.struct(F.col("__o").isNotNull(), "__o")))
    return rows.groupBy(*key).agg(known[value].alias(value))


def matched(rows: DataFrame, commands: DataFrame, key: list[str], guards: list[str]) -> DataFrame:
    """The key columns of rows that a command matches in key and guards."""
    return commands.select(*key, *guards).distinct().join(rows.select(*key, *guards), [*key, *guards], "left_semi").select(*key).distinct()


def compare_and_set(rows: DataFrame, commands: DataFrame, key: list[str], guards: list[str], assign: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows, outcomes): where a command's guards equal a row's columns, its columns assign[c] replace the row's c.

    outcomes are the commands with ``applied``. At most one command a key is to match; nulls match nothing.
    """
    new = commands.select(*key, *guards, *(F.col(v).alias(f"__{c}") for c, v in assign.items())).withColumn("__hit", F.lit(True))
    joined = rows.join(new, [*key, *guards], "left")
    after = joined.select(*(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in assign else F.col(c) for c in rows.columns))
    hit = rows.select(*key, *guards).distinct().withColumn("__hit", F.lit(True))
    outcomes = commands.join(hit, [*key, *guards], "left").select(*commands.columns, F.coalesce("__hit", F.lit(False)).alias("applied"))
    return after, outcomes


def delete_returning(rows: DataFrame, commands: DataFrame, key: list[str], guards: list[str] = []) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """(kept, deleted) rows when commands (key, guards) delete; a row that differs in a guard is kept."""
    hit = matched(rows, commands, key, guards)
    return rows.join(hit, key, "left_anti"), rows.join(hit, key, "left_semi")


def apply_pushes(refs: DataFrame, heads: DataFrame, versions: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(refs, heads, versions) after one batch a repository of accepted commands (repo_id, name, new_oid, pos), all at once.

    A zero new_oid deletes the ref. HEAD follows by ``head_retarget``. Each repository's ref_version grows by one if the batch has a command.
    """
    moved = accepted.select("repo_id", "name", F.col("new_oid").alias("oid"), "pos")
    after = upsert(refs, moved, ["repo_id", "name"], "pos").where(F.col("oid") != ZERO)
    to = head_retarget(accepted, refs, heads).select("repo_id", F.concat(F.lit("refs/heads/"), "branch").alias("__to"))
    turned = heads.join(to, "repo_id", "left").withColumn("target", F.coalesce("__to", "target")).withColumn("kind", F.when(F.col("__to").isNotNull(), "symbolic").otherwise(F.col("kind"))).select(*heads.columns)
    some = accepted.select("repo_id").distinct().withColumn("__one", F.lit(1))
    return after, turned, versions.join(some, "repo_id", "left").withColumn("ref_version", F.col("ref_version") + F.coalesce("__one", F.lit(0))).drop("__one")


def record_pushes(repositories: DataFrame, stamps: DataFrame) -> DataFrame:
    """repositories with last_push_at of stamps (namespace_slug, name, pushed_at, branch); default_branch changes only where branch is not null."""
    new = stamps.select("namespace_slug", "name", F.col("pushed_at").alias("__at"), F.col("branch").alias("__branch"))
    rows = repositories.join(new, ["namespace_slug", "name"], "left")
    return rows.withColumns({"last_push_at": F.coalesce("__at", "last_push_at"), "default_branch": F.coalesce("__branch", "default_branch")}).select(*repositories.columns)


def import_branches(refs: DataFrame, shallow: DataFrame, heads: DataFrame, versions: DataFrame, imports: DataFrame, boundaries: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(refs, shallow, heads, versions) after imports (repo_id, branch, oid): each replaces all refs and boundaries of its repository.

    Of the advertised boundaries (repo_id, oid) only those that arrived as commits are kept.
    """
    gone = imports.select("repo_id").distinct()
    name = F.concat(F.lit("refs/heads/"), "branch")
    came = boundaries.select("repo_id", "oid").distinct().join(gone, "repo_id", "left_semi").join(objects.where("type = 'commit'").select("repo_id", "oid"), ["repo_id", "oid"], "left_semi")
    return (refs.join(gone, "repo_id", "left_anti").unionByName(imports.select("repo_id", name.alias("name"), "oid")), shallow.join(gone, "repo_id", "left_anti").unionByName(came),
            heads.join(gone, "repo_id", "left_anti").unionByName(imports.select("repo_id", F.lit("symbolic").alias("kind"), name.alias("target"))),
            versions.join(gone.withColumn("__one", F.lit(1)), "repo_id", "left").withColumn("ref_version", F.col("ref_version") + F.coalesce("__one", F.lit(0))).drop("__one"))


def drop_repositories(gone: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """tables without the rows of gone (repo_id): a reset of an import, or a delete."""
    dead = gone.select("repo_id").distinct()
    return [t.join(dead, "repo_id", "left_anti") for t in tables]


def shallow_lists(shallow: DataFrame) -> DataFrame:
    """(repo_id, oids) of each repository's boundaries, in order: what an advertisement names."""
    return shallow.groupBy("repo_id").agg(F.array_sort(F.collect_set("oid")).alias("oids"))


def boundaries(*parts: DataFrame) -> DataFrame:
    """The union of sets of boundaries (repo_id, oid)."""
    return reduce(DataFrame.unionByName, (p.select("repo_id", "oid") for p in parts)).distinct()
