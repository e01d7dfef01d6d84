"""Registered queries over objects as bytes: their fields, links, walks over parsed links, packs written and read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashgrove.functions import codec, objects
from hashgrove.functions.names import object_id
from hashgrove.operators import graph, packs
from hashgrove.plans.registry import query, walk_sql
from hashgrove.sources.fixtures import fixture


def stored(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "fx_bytes").select("repo_id", "oid", "type", F.unhex("raw").alias("bytes"))


OID = "sha1('{}:' || conv_id || ':' || {})".format
BAD_COMMIT, BAD_TREE, BAD_TAG = "conv_id % 13 = 5 AND turn = 1", "conv_id % 17 = 3 AND turn = 2", "conv_id % 20 = 15"


@query(f"""SELECT conv_id // 10 AS repo_id, {OID('c', 'turn')} AS oid, CASE WHEN NOT bad THEN {OID('t', 'turn')} END AS tree, CASE WHEN NOT bad THEN CASE WHEN turn > 0 THEN {OID('c', '(turn - 1)')} ELSE '' END END AS parents,
CASE WHEN NOT bad THEN 'turn ' || turn || chr(10) END AS message, CASE WHEN NOT bad THEN role END AS author, CASE WHEN NOT bad THEN role || '@example.org' END AS author_email, CASE WHEN NOT bad THEN conv_id * 100 + turn END AS authored_at,
CASE WHEN NOT bad THEN role END AS committer, CASE WHEN NOT bad THEN 'c@example.org' END AS committer_email, CASE WHEN NOT bad THEN conv_id * 100 + turn + 7 END AS committed_at, CASE WHEN bad THEN 'committer' END AS fault
FROM (SELECT *, {BAD_COMMIT} AS bad FROM conversations)""")
def parse_commits(spark, d):
    return objects.commit_fields(stored(spark, d).where("type = 'commit'")).withColumn("parents", F.array_join("parents", ","))


ENTRIES = f"""e AS (SELECT a.conv_id // 10 AS repo_id, a.conv_id, a.turn, b.turn::INT AS pos, CASE b.turn % 4 WHEN 1 THEN '100755' WHEN 2 THEN '120000' WHEN 3 THEN '160000' ELSE '100644' END AS mode, 'f' || b.turn AS name, sha1('b:' || b.conv_id || ':' || b.turn) AS child,
  CASE b.turn % 4 WHEN 1 THEN 'exec' WHEN 2 THEN 'symlink' WHEN 3 THEN 'gitlink' ELSE 'blob' END AS type FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn <= a.turn
  UNION ALL SELECT conv_id // 10, conv_id, turn, (turn + 1)::INT, '40000', 'sub', {OID('t', '(turn - 1)')}, 'tree' FROM conversations WHERE turn > 0)"""


@query(f"""WITH {ENTRIES} SELECT repo_id, {OID('t', 'turn')} AS oid, pos, mode, name, child, type, NULL::VARCHAR AS fault FROM e WHERE NOT ({BAD_TREE})
UNION ALL SELECT conv_id // 10, {OID('t', 'turn')}, -1, NULL, NULL, NULL, NULL, 'malformed' FROM conversations WHERE {BAD_TREE}""")
def parse_trees(spark, d):
    return objects.tree_rows(stored(spark, d).where("type = 'tree'"))


LINKS = f"""{ENTRIES}, k AS (SELECT repo_id, {OID('t', 'turn')} AS source, 'tree' AS source_type, pos, child AS target, CASE WHEN type = 'tree' THEN 'tree' ELSE 'blob' END AS target_type, NULL::VARCHAR AS fault FROM e WHERE NOT ({BAD_TREE}) AND type <> 'gitlink'
  UNION ALL SELECT conv_id // 10, {OID('t', 'turn')}, 'tree', -1, NULL, NULL, 'malformed' FROM conversations WHERE {BAD_TREE}
  UNION ALL SELECT conv_id // 10, {OID('c', 'turn')}, 'commit', 0, {OID('t', 'turn')}, 'tree', NULL FROM conversations
  UNION ALL SELECT conv_id // 10, {OID('c', 'turn')}, 'commit', 1, {OID('c', '(turn - 1)')}, 'commit', NULL FROM conversations WHERE turn > 0
  UNION ALL SELECT conv_id // 10, sha1('g:' || conv_id), 'tag', CASE WHEN {BAD_TAG} THEN -1 ELSE 0 END, CASE WHEN NOT ({BAD_TAG}) THEN sha1('c:' || conv_id || ':' || max(turn)) END, CASE WHEN NOT ({BAD_TAG}) THEN 'commit' END, CASE WHEN {BAD_TAG} THEN 'type' END FROM conversations WHERE conv_id % 5 = 0 GROUP BY conv_id)"""


@query(f"WITH {LINKS} SELECT * FROM k")
def object_links(spark, d):
    return objects.object_links(stored(spark, d))


def roots(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "fx_refs").select("repo_id", F.sha1("oid").alias("oid"))


ROOTS = "SELECT repo_id, sha1(oid) AS oid FROM fx_refs"


@query(f"WITH {LINKS}, e2 AS (SELECT * FROM k WHERE fault IS NULL), {walk_sql(ROOTS, 'e2')} SELECT repo_id, oid FROM w")
def closure_from_bytes(spark, d):
    return graph.closure(objects.object_links(stored(spark, d)).where("fault IS NULL"), roots(spark, d))


@query(f"""WITH {LINKS}, e2 AS (SELECT * FROM k WHERE fault IS NULL AND target_type <> 'blob'), {walk_sql(ROOTS, 'e2')}
SELECT repo_id, min(oid) AS first_missing, count(*) AS n FROM w WHERE (repo_id, oid) IN (SELECT (repo_id, source) FROM k WHERE fault IS NOT NULL) GROUP BY repo_id""")
def connectivity_check(spark, d):
    """Per repository, objects that refs reach, blobs aside, and that cannot be read: not stored, or not parsed."""
    links = objects.object_links(stored(spark, d))
    found = graph.closure(links.where("fault IS NULL"), roots(spark, d), include_blobs=False)
    sound = stored(spark, d).select("repo_id", "oid").join(links.where("fault IS NOT NULL").select("repo_id", F.col("source").alias("oid")), ["repo_id", "oid"], "left_anti")
    return graph.missing(found, sound).groupBy("repo_id").agg(F.min("oid").alias("first_missing"), F.count("*").alias("n"))


@query("SELECT repo_id, type, sha1(encode(type || ' ' || octet_length(unhex(raw))) || '\\x00'::BLOB || unhex(raw)) AS oid FROM fx_bytes WHERE type IN ('tree', 'commit')")
def tree_and_commit_ids(spark, d):
    return stored(spark, d).where("type IN ('tree', 'commit')").select("repo_id", "type", object_id(F.col("type"), F.col("bytes")).alias("oid"))


def to_pack(spark: SparkSession, d: str) -> DataFrame:
    """Entries of one pack a repository: of two successive trees of a conversation the later is a delta on the earlier, all else is whole."""
    rows = stored(spark, d).withColumn("name", object_id(F.col("type"), F.col("bytes")))
    trees = rows.where("type = 'tree'").select("repo_id", "oid", "name", "bytes")
    turns = spark.read.parquet(f"{d}/conversations.parquet").where("turn % 2 = 1").select(F.sha1(F.concat(F.lit("t:"), "conv_id", F.lit(":"), "turn")).alias("oid"), F.sha1(F.concat(F.lit("t:"), "conv_id", F.lit(":"), F.col("turn") - 1)).alias("before"))
    below = trees.select("repo_id", F.col("oid").alias("before"), F.col("name").alias("base"), F.col("bytes").alias("base_bytes"))
    pairs = trees.join(turns, "oid").join(below, ["repo_id", "before"]).select("repo_id", "oid", "base", codec.delta_of("base_bytes", "bytes").alias("delta"))
    rows = rows.join(pairs, ["repo_id", "oid"], "left")
    place = F.expr("row_number() OVER (PARTITION BY repo_id ORDER BY base IS NOT NULL, oid)") - 1
    return rows.select("repo_id", place.alias("place"), "type", F.coalesce("delta", "bytes").alias("bytes"), "base")


@query("SELECT repo_id, type, sha1(encode(type || ' ' || octet_length(unhex(raw))) || '\\x00'::BLOB || unhex(raw)) AS oid, octet_length(unhex(raw)) AS size, count(*) AS copies FROM fx_bytes GROUP BY ALL")
def pack_roundtrip(spark, d):
    """Every object through a written pack, a third of the trees as deltas, and read again."""
    frames = packs.pack_stream(to_pack(spark, d)).groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("part", "frame"))).alias("frames"))
    whole = frames.select(F.col("repo_id").cast("string").alias("path"), F.aggregate("frames", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["frame"])).alias("content"))
    read = packs.unpacked(whole)
    return read.groupBy(F.col("path").cast("long").alias("repo_id"), "type", "oid", F.octet_length("bytes").alias("size")).agg(F.count("*").alias("copies"))
