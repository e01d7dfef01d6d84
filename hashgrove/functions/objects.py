"""What stored bytes of commits, trees and tags say: their fields, their entries, and the objects that they name."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashgrove.functions.codec import tree_entries

OID = "^[0-9a-f]{40}$"
#: Modes of tree entries and what they stand for; others are ``blob``.
TREE, GITLINK, SYMLINK, EXEC = "40000", "160000", "120000", "100755"
IDENTITY, SAFE = r"^(.*) <([^<>]*)> (-?[0-9]+)(?: [+-][0-9]{4})?$", (1 << 53) - 1
TRIM = r"^[\s\x{A0}\x{FEFF}\x{2028}\x{2029}]+|[\s\x{A0}\x{FEFF}\x{2028}\x{2029}]+$"


def text_of(raw: Column) -> Column:
    return F.make_valid_utf8(raw.cast("string"))


def head_lines(text: Column) -> Column:
    """Lines before the first empty one, or all."""
    end = F.instr(text, "\n\n")
    return F.split(F.when(end > 0, F.substr(text, F.lit(1), end - 1)).otherwise(text), "\n")


def values(lines: Column, field: str) -> Column:
    """What stands behind the first blank of each line of that field."""
    return F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(field + " "))), lambda x: F.substr(x, F.lit(len(field) + 2)))


def commit_fields(objects: DataFrame) -> DataFrame:
    """(repo_id, oid, tree, parents, message, author, author_email, authored_at, committer, committer_email, committed_at, fault)
    of objects (repo_id, oid, bytes) that are commits.

    Lines that begin with a blank go on with the line before and are skipped; exactly one trailing line feed of the message
    goes. ``fault`` names the first fault, and then the fields are null: no-separator, malformed-header, tree, parent,
    identity-missing, author, author-timestamp, committer, committer-timestamp. Null bytes have no separator.
    """
    text = F.coalesce(text_of(F.col("bytes")), F.lit(""))
    rows = objects.select("repo_id", "oid", text.alias("text")).withColumn("lines", F.filter(head_lines(F.col("text")), lambda x: ~F.startswith(x, F.lit(" "))))
    rows = rows.select("repo_id", "oid", "text", "lines", F.instr("text", "\n\n").alias("end"), *(F.get(values(F.col("lines"), f), F.lit(0)).alias(f) for f in ("tree", "author", "committer")), values(F.col("lines"), "parent").alias("parents"))
    part = lambda who, k: F.regexp_extract(who, IDENTITY, k)
    seconds = lambda who: part(who, 3).try_cast("long")
    unsafe = lambda who: F.coalesce(F.abs(seconds(who)) > SAFE, F.lit(True))
    fault = (F.when(F.col("end") == 0, "no-separator").when(F.exists("lines", lambda x: F.instr(x, " ") == 0), "malformed-header")
             .when(~F.coalesce(F.col("tree").rlike(OID), F.lit(False)), "tree").when(F.exists("parents", lambda p: ~p.rlike(OID)), "parent")
             .when(F.col("author").isNull() | F.col("committer").isNull(), "identity-missing"))
    for who in ("author", "committer"):
        fault = fault.when(~F.col(who).rlike(IDENTITY), who).when(unsafe(who), f"{who}-timestamp")
    rows = rows.withColumn("fault", fault)
    good = lambda c: F.when(F.col("fault").isNull(), c)
    message = F.regexp_replace(F.substr("text", F.col("end") + 2), r"\n\z", "")
    return rows.select("repo_id", "oid", good(F.col("tree")).alias("tree"), good(F.col("parents")).alias("parents"), good(message).alias("message"),
                       *(good(c).alias(n) for who, at in (("author", "authored_at"), ("committer", "committed_at")) for c, n in ((part(who, 1), who), (part(who, 2), f"{who}_email"), (seconds(who), at))), "fault")


def tree_rows(objects: DataFrame) -> DataFrame:
    """(repo_id, oid, pos, mode, name, child, type, fault) of the entries of objects (repo_id, oid, bytes) that are trees.

    ``type`` is tree, gitlink, symlink, exec or blob. A malformed tree gives one row with pos -1 and fault ``malformed``,
    an empty one none. A tree is one value of a row, so an Arrow batch is what a task holds.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for repo, oid, raw in zip(pdf.repo_id, pdf.oid, pdf.bytes):
                try:
                    out += [(repo, oid, i, *e, None) for i, e in enumerate(tree_entries(bytes(raw or b"")))]
                except ValueError:
                    out = [x for x in out if x[:2] != (repo, oid)] + [(repo, oid, -1, None, None, None, "malformed")]
            yield pd.DataFrame(out, columns=["repo_id", "oid", "pos", "mode", "name", "child", "fault"])

    rows = objects.select("repo_id", "oid", "bytes").mapInPandas(run, "repo_id long, oid string, pos int, mode string, name string, child string, fault string")
    kind = F.when(F.col("mode") == TREE, "tree").when(F.col("mode") == GITLINK, "gitlink").when(F.col("mode") == SYMLINK, "symlink").when(F.col("mode") == EXEC, "exec").when(F.col("mode").isNotNull(), "blob")
    return rows.select("repo_id", "oid", "pos", "mode", "name", "child", kind.alias("type"), "fault")


def object_links(objects: DataFrame) -> DataFrame:
    """(repo_id, source, source_type, pos, target, target_type, fault) of what objects (repo_id, oid, type, bytes) name.

    A commit names its tree, then its parents; a tag its object, of the type it declares; a tree its subtrees and blobs, no
    gitlinks. Of equal targets of a source the first counts. An object that cannot be parsed gives one row of pos -1 with
    a fault, and no links: tree, parent, object, type or malformed. Blobs name nothing.
    """
    text = F.coalesce(text_of(F.col("bytes")), F.lit(""))
    lines = head_lines(text)
    named = lambda f: F.transform(values(lines, f), lambda x: F.regexp_replace(x, TRIM, ""))
    first = lambda f: F.get(named(f), F.lit(0))
    is_id = lambda c: F.coalesce(c.rlike(OID), F.lit(False))
    link = lambda oid, kind: F.struct(oid.alias("target"), kind.alias("target_type"))
    heads = objects.where("type IN ('commit', 'tag')").select("repo_id", F.col("oid").alias("source"), F.col("type").alias("source_type"),
        first("tree").alias("tree"), named("parent").alias("parents"), first("object").alias("object"), first("type").alias("declared"))
    known = F.coalesce(F.col("declared").isin("commit", "tree", "blob", "tag"), F.lit(False))
    fault = F.when(F.col("source_type") == "tag", F.when(~is_id(F.col("object")), "object").when(~known, "type")).when(~is_id(F.col("tree")), "tree").when(F.exists("parents", lambda p: ~is_id(p)), "parent")
    links = F.when(F.col("source_type") == "tag", F.array(link(F.col("object"), F.col("declared")))).otherwise(F.concat(F.array(link(F.col("tree"), F.lit("tree"))), F.transform("parents", lambda p: link(p, F.lit("commit")))))
    heads = heads.withColumns({"fault": fault}).withColumn("links", F.when(F.col("fault").isNull(), links).otherwise(F.array(link(F.lit(None).cast("string"), F.lit(None).cast("string")))))
    rows = heads.select("repo_id", "source", "source_type", F.posexplode("links").alias("pos", "link"), "fault").select("repo_id", "source", "source_type", F.when(F.col("fault").isNull(), F.col("pos")).otherwise(-1).alias("pos"), "link.target", "link.target_type", "fault")
    trees = tree_rows(objects.where("type = 'tree'")).where("fault IS NOT NULL OR type <> 'gitlink'")
    trees = trees.select("repo_id", F.col("oid").alias("source"), F.lit("tree").alias("source_type"), "pos", F.col("child").alias("target"), F.when(F.col("fault").isNull(), F.when(F.col("type") == "tree", "tree").otherwise("blob")).alias("target_type"), "fault")
    own = Window.partitionBy("repo_id", "source", "target").orderBy("pos")
    return rows.unionByName(trees).withColumn("__nth", F.row_number().over(own)).where("__nth = 1").drop("__nth")
