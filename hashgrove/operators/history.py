"""History of a revision, newest first, and where revisions and paths lead."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain, groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashgrove.plans.staging import cut

KEY = ["repo_id", "oid"]
#: Modes of tree entries that are no files.
TREE, GITLINK = "40000", "160000"


def history(commits: DataFrame, tips: DataFrame, limit: int, offset: int = 0, shallow: DataFrame | None = None) -> DataFrame:
    """(repo_id, seq, oid, fault) of a page of each repository's history from its tips (repo_id, oid).

    commits are (repo_id, oid, parents, committed_at). Of the commits known but not yet listed the newest comes next, ties
    as first met, so a child stands before its parents even where clocks are skewed; a shallow commit is listed, its
    parents are not. A parent that is not stored gives a row with seq -1 and fault ``missing``: such a repository has no valid page.

    Each repository's rows stream sorted by date. A task holds the commits met before a child of theirs, not the history.
    """
    rows = commits.select(*KEY, "parents", "committed_at")
    if shallow is not None:
        mark = shallow.select(*KEY).distinct().withColumn("__cut", F.lit(True))
        rows = rows.join(mark, KEY, "left").select(*KEY, F.when(F.col("__cut").isNull(), F.col("parents")).alias("parents"), "committed_at")
    rows = rows.select("repo_id", F.lit(1).alias("kind"), "oid", "parents", "committed_at")
    heads = tips.select("repo_id", F.lit(0).alias("kind"), "oid", F.lit(None).cast("array<string>").alias("parents"), F.lit(0).cast("long").alias("committed_at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = chain.from_iterable(zip(b.repo_id, b.kind, b.oid, b.parents, b.committed_at) for b in batches)
        held = []
        for repo, own in groupby(stream, key=lambda r: r[0]):
            for row in walk(own, limit, offset):
                held.append((repo, *row))
                if len(held) == 10_000:
                    yield pd.DataFrame(held, columns=["repo_id", "seq", "oid", "fault"])
                    held = []
        yield pd.DataFrame(held, columns=["repo_id", "seq", "oid", "fault"])

    ordered = heads.unionByName(rows).repartition("repo_id").sortWithinPartitions("repo_id", "kind", F.desc("committed_at"), "oid")
    return ordered.mapInPandas(run, "repo_id long, seq int, oid string, fault string")


def walk(rows: Iterator[tuple], limit: int, offset: int) -> Iterator[tuple]:
    """Rows (repo, kind, oid, parents, date), tips first and then newest first, to (seq, oid, fault)."""
    known: dict[str, int] = {}
    due: set[str] = set()
    early: dict[str, tuple] = {}
    listed = 0
    for (kind, date), same in groupby(rows, key=lambda r: (r[1], r[4])):
        heap = []
        for _, _, oid, parents, _ in same:
            if kind == 0:
                if oid not in known:
                    known[oid] = len(known)
                    due.add(oid)
            elif oid in due:
                due.discard(oid)
                heapq.heappush(heap, (-date, known[oid], oid, parents))
            elif oid not in known and listed < offset + limit:
                early[oid] = (-date, parents)
        while heap and listed < offset + limit:
            _, _, oid, parents = heapq.heappop(heap)
            listed += 1
            if listed > offset:
                yield listed - offset - 1, oid, None
            if listed == offset + limit:
                early.clear()
                break
            for parent in parents if parents is not None else ():
                if parent not in known:
                    known[parent] = len(known)
                    if parent in early:
                        at, above = early.pop(parent)
                        heapq.heappush(heap, (at, known[parent], parent, above))
                    else:
                        due.add(parent)
    for oid in sorted(due):
        yield -1, oid, "missing"


def resolve_revision(requests: DataFrame, refs: DataFrame, heads: DataFrame, objects: DataFrame, links: DataFrame, oid_pattern: str = "^[0-9a-f]{40}$") -> DataFrame:
    """requests (repo_id, request, revision) with the ``commit`` that each names, or its ``fault``.

    An id wins over a branch, a branch over a tag; a null revision is HEAD: heads (repo_id, kind 'detached' or 'symbolic', target).
    An unborn HEAD has neither commit nor fault. Tags are followed to a commit; a chain that returns to itself is corrupt.
    """
    named = refs.select("repo_id", F.col("name"), F.col("oid").alias("found"))
    at = lambda prefix, as_: named.where(F.col("name").startswith(prefix)).select("repo_id", F.substr("name", F.lit(len(prefix) + 1)).alias("revision"), F.col("found").alias(as_))
    head = heads.select("repo_id", "kind", "target").join(named.withColumnRenamed("name", "target"), ["repo_id", "target"], "left")
    head = head.select("repo_id", F.when(F.col("kind") == "detached", F.col("target")).otherwise(F.col("found")).alias("head"), (F.col("kind") != "detached").alias("symbolic"))
    rows = requests.join(at("refs/heads/", "branch"), ["repo_id", "revision"], "left").join(at("refs/tags/", "tag"), ["repo_id", "revision"], "left").join(head, "repo_id", "left")
    start = F.when(F.col("revision").isNull(), F.col("head")).when(F.col("revision").rlike(oid_pattern), F.col("revision")).otherwise(F.coalesce("branch", "tag"))
    unborn = F.col("revision").isNull() & F.col("symbolic") & F.col("head").isNull()
    keep = ["repo_id", "request", "revision"]
    state = rows.select(*keep, start.alias("at"), F.coalesce(unborn, F.lit(False)).alias("unborn"))
    state = cut(state.select(*keep, "at", F.array("at").alias("seen"), F.lit(None).cast("string").alias("commit"), F.when(F.col("at").isNull() & ~F.col("unborn"), "revision-not-found").alias("fault"), (F.col("at").isNotNull()).alias("open")))
    kinds = objects.select("repo_id", F.col("oid").alias("at"), "type")
    targets = links.select("repo_id", F.col("source").alias("at"), "target")
    done = state.where("NOT open").select(*keep, "commit", "fault")
    while not (live := state.where("open")).isEmpty():
        typed = live.drop("commit", "fault").join(kinds, ["repo_id", "at"], "left")
        tags = typed.where("type = 'tag'").join(targets, ["repo_id", "at"], "left")
        ended = typed.where("type IS NULL OR type <> 'tag'").select(*keep, "at", "seen", F.when(F.col("type") == "commit", F.col("at")).alias("commit"), F.when(F.col("type").isNull(), "revision-not-found").when(F.col("type") != "commit", "wrong-object-type").alias("fault"), F.lit(False).alias("open"))
        bad = F.col("target").isNull() | F.array_contains("seen", F.col("target"))
        moved = tags.select(*keep, F.col("target").alias("at"), F.concat("seen", F.array("target")).alias("seen"), F.lit(None).cast("string").alias("commit"), F.when(bad, "corrupt").alias("fault"), (~bad).alias("open"))
        state = cut(ended.unionByName(moved))
        done = done.unionByName(state.where("NOT open").select(*keep, "commit", "fault"))
    return done


def resolve_path(starts: DataFrame, entries: DataFrame, objects: DataFrame) -> DataFrame:
    """starts (repo_id, request, tree, path) with the ``oid`` of the file that path names, or its ``fault``.

    entries are (repo_id, tree, pos, name, mode, oid); of equal names in a tree the first counts. An empty segment is
    file-not-found, a directory or gitlink at the end wrong-object-type, a tree or file that is not stored corrupt. One
    round a segment, for all requests at once.
    """
    keep = ["repo_id", "request", "path"]
    first = entries.groupBy("repo_id", "tree", "name").agg(F.min_by(F.struct("mode", "oid"), "pos").alias("e")).select("repo_id", "tree", "name", "e.mode", F.col("e.oid").alias("child"))
    trees = objects.where("type = 'tree'").select("repo_id", F.col("oid").alias("tree")).distinct().withColumn("whole", F.lit(True))
    blobs = objects.where("type = 'blob'").select("repo_id", F.col("oid").alias("child")).distinct().withColumn("stored", F.lit(True))
    parts = F.split("path", "/", -1)
    bad = F.col("path").isNull() | F.exists(parts, lambda p: p == "")
    state = cut(starts.select(*keep, "tree", F.when(bad, F.array().cast("array<string>")).otherwise(parts).alias("rest"), F.when(bad, "file-not-found").alias("fault")))
    done = state.where("fault IS NOT NULL").select(*keep, F.lit(None).cast("string").alias("oid"), "fault")
    live = state.where("fault IS NULL").drop("fault")
    while not live.isEmpty():
        step = live.withColumn("name", F.col("rest")[0]).join(trees, ["repo_id", "tree"], "left").join(first, ["repo_id", "tree", "name"], "left").join(blobs, ["repo_id", "child"], "left")
        last = F.size("rest") == 1
        fault = (F.when(F.col("whole").isNull(), "corrupt").when(F.col("mode").isNull(), "file-not-found")
                 .when(~last & (F.col("mode") != TREE), "file-not-found").when(last & F.col("mode").isin(TREE, GITLINK), "wrong-object-type")
                 .when(last & F.col("stored").isNull(), "corrupt"))
        step = cut(step.select(*keep, F.col("child").alias("tree"), F.slice("rest", F.lit(2), F.greatest(F.size("rest") - 1, F.lit(0))).alias("rest"), fault.alias("fault"), last.alias("last")))
        done = done.unionByName(step.where("last OR fault IS NOT NULL").select(*keep, F.when(F.col("fault").isNull(), F.col("tree")).alias("oid"), "fault"))
        live = step.where("NOT last AND fault IS NULL").drop("fault", "last")
    return done
