"""Reachability over typed edges: closure, difference, missing objects, depth, peeling, mark and sweep.

Repositories are independent, so every frame carries repo_id and all joins are on (repo_id, oid): one loop walks
all repositories at once. Histories are mostly long chains, so commits are first contracted to paths by pointer
jumping, and the walk goes from path to path: its rounds grow with the number of branchings on the way, not with
the length of a history. Each round writes its frontier to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashgrove.plans.staging import counted_cut, cut

KEY = ["repo_id", "oid"]
#: Hops of one round of pointer jumping.
HOPS = 4


def walkable(links: DataFrame, shallow: DataFrame | None = None, include_blobs: bool = True) -> DataFrame:
    """Edges a walk may follow: a shallow commit keeps its tree but loses its parents; blobs below trees on request."""
    if not include_blobs:
        links = links.where("NOT (source_type = 'tree' AND target_type = 'blob')")
    if shallow is not None:
        above = "target_type = 'commit' AND source_type = 'commit'"
        commits = links.where(above).join(shallow.select("repo_id", F.col("oid").alias("source")), ["repo_id", "source"], "left_anti")
        links = links.where(f"NOT ({above})").unionByName(commits)
    return links


def paths(steps: DataFrame, group: list[str]) -> DataFrame:
    """(group, oid, path, dist) of the nodes of disjoint paths along steps (group, source, target): each source goes on to its
    least target, if it is that target's least source. ``path`` is the last node, ``dist`` the steps to it. Nodes of a
    cycle and nodes on no path have no row. A round jumps HOPS pointers, so a path of n nodes takes about log(n)/log(HOPS) rounds.
    """
    up = steps.where("source <> target").groupBy(*group, "source").agg(F.min("target").alias("target"))
    state = up.groupBy(*group, "target").agg(F.min("source").alias("oid")).select(*group, "oid", F.col("target").alias("ptr"), F.lit(1).cast("long").alias("dist"), F.lit(True).alias("open"))
    state, left = counted_cut(state)
    longest = left
    while left and longest:
        hop = state.select(*group, F.col("oid").alias("ptr"), F.col("ptr").alias("__to"), F.col("dist").alias("__more"))
        for _ in range(HOPS - 1):
            state = state.join(hop, [*group, "ptr"], "left").select(*group, "oid", F.coalesce("__to", "ptr").alias("ptr"), (F.col("dist") + F.coalesce("__more", F.lit(0))).alias("dist"), F.col("__to").isNotNull().alias("open"))
        state, left = counted_cut(state, "open")
        longest //= HOPS
    done = state.where("NOT open").select(*group, "oid", F.col("ptr").alias("path"), "dist")
    return done.unionByName(done.select(*group, F.col("path").alias("oid"), "path", F.lit(0).cast("long").alias("dist")).distinct())


def closure(links: DataFrame, roots: DataFrame, stop_at: DataFrame | None = None, shallow: DataFrame | None = None, include_blobs: bool = True, group: list[str] = ["repo_id"]) -> DataFrame:  # noqa: B006
    """(group, oid) of all that roots (group, oid) reach over links (group, source, source_type, target, target_type).

    stop_at objects are left out and not walked; rows of different groups never meet. What is reached of a path is all from
    its reached node of most ``dist`` on, so a frontier is one number a path. Targets that are stored nowhere are
    reached too; roots without links are reached alone; repeated links and roots count once; cycles end.
    """
    edges = walkable(links, shallow, include_blobs).select(*group, "source", "target", ((F.col("source_type") == "commit") & (F.col("target_type") == "commit")).alias("step"))
    roots = roots.select(*group, "oid").distinct()
    if stop_at is not None:
        stops = stop_at.select(*group, "oid").distinct()
        roots = roots.join(stops, [*group, "oid"], "left_anti")
        edges = reduce(lambda e, end: e.join(stops.withColumnRenamed("oid", end), [*group, end], "left_anti"), ("source", "target"), edges)
    edges = cut(edges)
    path = cut(paths(edges.where("step"), group))
    at = lambda end, p, d: path.select(*group, F.col("oid").alias(end), F.col("path").alias(f"__{p}"), F.col("dist").alias(f"__{d}"))
    inner = edges.join(at("source", "sp", "sd"), [*group, "source"], "left").join(at("target", "tp", "td"), [*group, "target"], "left")
    zero = F.lit(0).cast("long")
    inner = inner.select(*group, F.coalesce("__sp", "source").alias("path"), F.coalesce("__sd", zero).alias("sd"), F.coalesce("__tp", "target").alias("to"), F.coalesce("__td", zero).alias("td"))
    inner = cut(inner.where("path <> to OR td > sd"))
    start = roots.join(path, [*group, "oid"], "left").groupBy(*group, F.coalesce("path", "oid").alias("path")).agg(F.max(F.coalesce("dist", zero)).alias("reach"))
    frontier, left = counted_cut(start.withColumn("before", F.lit(-1).cast("long")))
    seen = frontier.select(*group, "path", "reach")
    while left:
        step = frontier.join(inner, [*group, "path"]).where("sd > before AND sd <= reach").groupBy(*group, F.col("to").alias("path")).agg(F.max("td").alias("reach"))
        known = seen.groupBy(*group, "path").agg(F.max("reach").alias("before"))
        step = step.join(known, [*group, "path"], "left").withColumn("before", F.coalesce("before", F.lit(-1).cast("long"))).where("reach > before")
        frontier, left = counted_cut(step.select(*group, "path", "reach", "before"))
        seen = seen.unionByName(frontier.select(*group, "path", "reach"))
    reached = seen.groupBy(*group, "path").agg(F.max("reach").alias("reach"))
    return reached.join(path, [*group, "path"], "left").where("dist IS NULL OR dist <= reach").select(*group, F.coalesce("oid", "path").alias("oid"))


def levels(links: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(repo_id, oid, depth) of what roots reach over fewer than ``depth`` links, by least number of links: one round each."""
    edges = cut(links.select("repo_id", "source", "target"))
    frontier, left = counted_cut(roots.select(*KEY).distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for k in range(1, depth):
        if not left:
            break
        step = frontier.select("repo_id", F.col("oid").alias("source")).join(edges, ["repo_id", "source"]).select("repo_id", F.col("target").alias("oid")).distinct()
        frontier, left = counted_cut(step.join(seen, KEY, "left_anti").withColumn("depth", F.lit(k)))
        seen = seen.unionByName(frontier)
    return seen


def complete_closure(found: DataFrame, objects: DataFrame) -> DataFrame:
    """(repo_id, complete, n): whether every member of a closure is a stored, complete object with indexed links; one that is not vetoes it.

    Where objects has no column ``complete`` or ``links_indexed``, its rows count as such.
    """
    marks = [F.col(c) for c in ("complete", "links_indexed") if c in objects.columns]
    have = objects.select(*KEY, reduce(lambda a, b: a & b, marks, F.lit(True)).alias("have"))
    return found.join(have, KEY, "left").groupBy("repo_id").agg(F.expr("bool_and(coalesce(have, false))").alias("complete"), F.count("*").alias("n"))


def missing(found: DataFrame, objects: DataFrame) -> DataFrame:
    return found.join(objects.select(*KEY), KEY, "left_anti").select(*KEY)


def fetch_difference(links: DataFrame, wants: DataFrame, haves: DataFrame, shallow: DataFrame | None = None, client_shallow: DataFrame | None = None, deepened: DataFrame | None = None) -> DataFrame:
    """What a client with ``haves`` lacks of ``wants``: their closure up to the haves, less all the haves reach. One loop walks both.

    The wants are walked up to ``shallow``, the haves up to ``client_shallow``. In repositories of deepened (repo_id) the walk goes through
    the haves, to what lies behind an old boundary of the client's.
    """
    group = ["walk", "repo_id"]
    marked = lambda df, *w: df.withColumn("walk", F.explode(F.array(*map(F.lit, w))))
    roots = marked(wants.select(*KEY), "want").unionByName(marked(haves.select(*KEY), "have"))
    stops = haves if deepened is None else haves.join(deepened.select("repo_id").distinct(), "repo_id", "left_anti")
    edges = marked(walkable(links, shallow), "want").unionByName(marked(walkable(links, client_shallow), "have"))
    found = closure(edges, roots, stop_at=marked(stops.select(*KEY), "want"), group=group)
    return found.groupBy(*KEY).agg(F.min("walk").alias("first")).where("first = 'want'").select(*KEY)


def depth_plan(links: DataFrame, wants: DataFrame, depth: int, repository_shallow: DataFrame | None = None, client_shallow: DataFrame | None = None) -> DataFrame:
    """(repo_id, oid, depth, shallow, unshallow) of the commits within ``depth`` of wants, counted from 1; tags among wants lead to their commits.

    Commits of repository_shallow are not walked past and are shallow; so are the last that have parents. A commit that the
    client holds as shallow and that is within the depth but not shallow is unshallow.
    """
    tags = links.where("source_type = 'tag'")
    reached = closure(tags, wants).join(tags.select("repo_id", F.col("source").alias("oid")), KEY, "left_anti")
    parents = links.where("target_type = 'commit' AND source_type = 'commit'")
    held = (repository_shallow if repository_shallow is not None else wants.limit(0)).select(*KEY).distinct()
    walked = levels(walkable(parents, held), reached, depth)
    has = parents.select("repo_id", F.col("source").alias("oid")).distinct().withColumn("has", F.lit(True))
    kept = (client_shallow if client_shallow is not None else wants.limit(0)).select(*KEY).distinct().withColumn("client", F.lit(True))
    rows = walked.join(has, KEY, "left").join(held.withColumn("graft", F.lit(True)), KEY, "left").join(kept, KEY, "left")
    shallow = F.col("graft").isNotNull() | (F.col("depth") == depth - 1) & F.col("has").isNotNull()
    return rows.select(*KEY, (F.col("depth") + 1).alias("depth"), shallow.alias("shallow"), (F.col("client").isNotNull() & ~shallow).alias("unshallow"))


def peel(refs: DataFrame, links: DataFrame, objects: DataFrame) -> DataFrame:
    """refs with ``peeled``: the object that a chain of tags ends at; null for a ref that is no tag, and where a chain returns
    to itself or leads to an object that is not stored. One round a link of the longest chain."""
    targets = links.where("source_type = 'tag'").select("repo_id", F.col("source").alias("at"), "target")
    types = objects.select("repo_id", F.col("oid").alias("at"), "type")
    state, left = counted_cut(refs.select(*KEY).distinct().select(*KEY, F.col("oid").alias("at"), F.array("oid").alias("seen")))
    done = []
    while left:
        typed = state.join(types, ["repo_id", "at"], "left").join(targets, ["repo_id", "at"], "left")
        ended = F.col("type").isNull() | (F.col("type") != "tag") | F.col("target").isNull() | F.array_contains("seen", F.col("target"))
        peeled = F.when((F.col("type") != "tag") & (F.col("at") != F.col("oid")), F.col("at"))
        step, left = counted_cut(typed.select(*KEY, F.when(ended, F.col("at")).otherwise(F.col("target")).alias("at"), F.concat("seen", F.array("target")).alias("seen"), peeled.alias("peeled"), ended.alias("ended")), "NOT ended")
        done.append(step.where("ended AND peeled IS NOT NULL").select(*KEY, "peeled"))
        state = step.where("NOT ended").select(*KEY, "at", "seen")
    found = reduce(DataFrame.unionByName, done) if done else refs.select(*KEY, F.lit(None).cast("string").alias("peeled")).limit(0)
    return refs.join(found, KEY, "left").select(*refs.columns, "peeled")


def mark(links: DataFrame, roots: DataFrame, objects: DataFrame, shallow: DataFrame | None = None) -> DataFrame:
    """(repo_id, oid, expected_type, fault) of all that a sweep keeps: what roots reach, with the least type that a link to it
    declares. One that is not stored is in order if a tree names it as a blob, else ``missing``, which stops a sweep."""
    found = closure(links, roots, shallow=shallow)
    declared = walkable(links, shallow).groupBy("repo_id", F.col("target").alias("oid")).agg(F.min("target_type").alias("expected_type"))
    stored = objects.select(*KEY, F.lit(True).alias("__stored"))
    rows = found.join(declared, KEY, "left").join(stored, KEY, "left")
    return rows.select(*KEY, "expected_type", F.when(F.col("__stored").isNull() & ~F.col("expected_type").eqNullSafe("blob"), "missing").alias("fault"))


def sweep(objects: DataFrame, links: DataFrame, refs: DataFrame) -> DataFrame:
    """Objects that no ref reaches."""
    return objects.join(closure(links, refs.select(*KEY)), KEY, "left_anti")


def fork(objects: DataFrame, links: DataFrame, roots: DataFrame, into: int) -> DataFrame:
    """The objects of a fork: the closure of roots, copied under the repo_id ``into``."""
    return objects.join(closure(links, roots), KEY, "left_semi").withColumn("repo_id", F.lit(into).cast(objects.schema["repo_id"].dataType))
