"""Registered queries over history, packs, revisions, paths and wire formats; importing this module completes the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashgrove.functions import codec, wire
from hashgrove.operators import graph, history, packs, refs
from hashgrove.plans import bytes as _bytes, lifecycle as _lifecycle  # noqa: F401  # register their queries
from hashgrove.plans.registry import ORACLES, QUERIES, SCREEN, TIPS, hex_line, one_push, parts, query, tips, walk_sql
from hashgrove.sources.fixtures import NOW, fixture

__all__ = ["ORACLES", "QUERIES"]

NUMBERED = "row_number() OVER (PARTITION BY repo_id ORDER BY oid)"
WINDOW = 2_048


def turn(c: str) -> F.Column:
    return F.split(c, ":")[2].cast("long")


def conv(c: str) -> F.Column:
    return F.split(c, ":")[1].cast("long")


def commits(spark: SparkSession, d: str) -> DataFrame:
    o, links, _ = parts(spark, d)
    above = links.where("target_type = 'commit' AND source LIKE 'c:%'").groupBy("repo_id", F.col("source").alias("oid")).agg(F.sort_array(F.collect_list("target")).alias("parents"))
    return o.where("type = 'commit'").join(above, ["repo_id", "oid"], "left").select("repo_id", "oid", "parents", (conv("oid") * 100 + turn("oid")).alias("committed_at"))


@query(f"""WITH e AS (SELECT * FROM fx_links WHERE target_type = 'commit'), {walk_sql(TIPS, 'e')},
n AS (SELECT repo_id, oid, row_number() OVER (PARTITION BY repo_id ORDER BY split_part(oid, ':', 2)::INT DESC, split_part(oid, ':', 3)::INT DESC) - 3 AS seq FROM w)
SELECT repo_id, seq::INT AS seq, oid, NULL::VARCHAR AS fault FROM n WHERE seq BETWEEN 0 AND 9""")
def history_walk(spark, d):
    return history.history(commits(spark, d), tips(parts(spark, d)[2]), limit=10, offset=2)


def chains(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Blobs and trees with positions, and each turn's delta on the turn before."""
    o = fixture(spark, d, "fx_objects").where("type IN ('blob', 'tree')").withColumn("pos", F.expr(NUMBERED))
    deltas = o.where(turn("oid") > 0).select("repo_id", "oid", F.concat_ws(":", F.split("oid", ":")[0], conv("oid"), turn("oid") - 1).alias("base"))
    return o, deltas


CHAIN = f"""o AS (SELECT repo_id, oid, type, size, split_part(oid, ':', 3)::INT AS turn, left(oid, 2) || split_part(oid, ':', 2) AS chain, {NUMBERED} AS pos FROM fx_objects WHERE type IN ('blob', 'tree')),
p AS (SELECT repo_id, oid, size, turn, (row_number() OVER (PARTITION BY repo_id ORDER BY turn, root) - 1)::INT AS place, CASE WHEN turn > 0 THEN chain || ':' || (turn - 1) END AS base
  FROM o JOIN (SELECT repo_id, chain, pos AS root FROM o WHERE turn = 0) USING (repo_id, chain))"""


@query(f"WITH {CHAIN} SELECT repo_id, oid, place, base FROM p")
def pack_order(spark, d):
    return packs.pack_order(*chains(spark, d))


@query(f"""WITH {CHAIN}, z AS (SELECT repo_id, oid, place, turn > 0 AS as_delta, CASE WHEN turn > 0 THEN size // 4 + 20 ELSE size * 3 END AS size FROM p),
r AS (SELECT *, size AS total, 0 AS win FROM z WHERE place = 0 UNION ALL
  SELECT z.*, CASE WHEN total + z.size > {WINDOW} THEN z.size ELSE total + z.size END, CASE WHEN total + z.size > {WINDOW} THEN win + 1 ELSE win END FROM r JOIN z ON z.repo_id = r.repo_id AND z.place = r.place + 1)
SELECT repo_id, oid, place, as_delta, size::BIGINT AS size, win AS "window" FROM r""")
def read_windows(spark, d):
    o, deltas = chains(spark, d)
    stored = o.select("repo_id", "oid", (F.col("size") * 3).alias("full_size"), F.lit(0).alias("full_keys"), F.when(turn("oid") > 0, F.expr("size DIV 4 + 20")).alias("delta_size"), F.lit(0).alias("delta_keys"))
    return packs.read_windows(packs.pack_order(o, deltas), stored, max_bytes=WINDOW)


SAME = "SELECT conv_id, turn, right('000' || turn, 3) || ':' || conv_id AS oid, sha1('a' || conv_id) || sha1('b' || conv_id) || sha1('c' || conv_id) || sha1('d' || conv_id) || sha1('e' || conv_id) || sha1('f' || conv_id) || sha1('g' || conv_id) || turn AS text FROM conversations"


@query(f"""WITH o AS (SELECT *, 'blob:' || (length(bin(octet_length(encode(text)))) - 1) AS bucket FROM ({SAME}))
SELECT conv_id AS repo_id, oid, first(oid) OVER w AS base, md5(text) AS digest FROM o WINDOW w AS (PARTITION BY conv_id, bucket ORDER BY oid) QUALIFY row_number() OVER w > 1""")
def repack_select(spark, d):
    """Texts of a conversation differ in their last figures, so all but the first of a size bucket become deltas on it."""
    rows = spark.sql(SAME.replace("FROM conversations", "FROM {c}"), c=spark.read.parquet(f"{d}/conversations.parquet"))
    blobs = rows.select(F.col("conv_id").alias("repo_id"), "oid", F.lit("blob").alias("type"), F.col("text").cast("binary").alias("bytes"), F.lit(None).cast("string").alias("base"))
    base = blobs.select("repo_id", F.col("oid").alias("base"), F.col("bytes").alias("base_bytes"))
    return packs.select_deltas(blobs).join(base, ["repo_id", "base"]).select("repo_id", "oid", "base", F.md5(codec.patched("base_bytes", "delta")).alias("digest"))


ASKED = "SELECT repo_id, conv_id * 4 + k AS request, CASE k WHEN 0 THEN 'conv-' || conv_id WHEN 1 THEN 'v' || conv_id WHEN 2 THEN 'nope' END AS revision FROM (SELECT DISTINCT conv_id @DIV 10 AS repo_id, conv_id FROM conversations) c CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(k)"
HEADS = "SELECT DISTINCT conv_id @DIV 10 AS repo_id, 'symbolic' AS kind, 'refs/heads/conv-' || (conv_id @DIV 10 * 10 + 2) AS target FROM conversations"


def small(spark: SparkSession, d: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("@DIV", "DIV").replace("FROM conversations", "FROM {conversations}"), conversations=spark.read.parquet(f"{d}/conversations.parquet"))


@query(f"""WITH a AS ({ASKED}), h AS ({HEADS}),
f AS (SELECT a.*, CASE WHEN revision IS NULL THEN x.oid ELSE coalesce(b.oid, t.oid) END AS oid FROM a JOIN h USING (repo_id) LEFT JOIN fx_refs x ON x.repo_id = a.repo_id AND x.name = h.target
  LEFT JOIN fx_refs b ON b.repo_id = a.repo_id AND b.name = 'refs/heads/' || revision LEFT JOIN fx_refs t ON t.repo_id = a.repo_id AND t.name = 'refs/tags/' || revision)
SELECT f.repo_id, request, revision, coalesce(l.target, f.oid) AS commit, CASE WHEN f.oid IS NULL AND revision IS NOT NULL THEN 'revision-not-found' END AS fault
FROM f LEFT JOIN fx_links l ON l.repo_id = f.repo_id AND l.source = f.oid AND f.oid LIKE 'g:%'""".replace("@DIV", "//"))
def resolve_revision(spark, d):
    o, links, r = parts(spark, d)
    return history.resolve_revision(small(spark, d, ASKED), r, small(spark, d, HEADS), o, links)


PATHS = "SELECT conv_id @DIV 10 AS repo_id, conv_id * 100 + turn * 5 + k AS request, 'd:' || conv_id AS tree, 't' || turn || tail AS path, conv_id, k FROM conversations CROSS JOIN (VALUES (0, '/f0'), (1, '/f99'), (2, ''), (3, '//f0'), (4, '/f0/x')) AS v(k, tail)"


@query(f"SELECT repo_id, request, path, CASE k WHEN 0 THEN 'b:' || conv_id || ':0' END AS oid, CASE k WHEN 0 THEN NULL WHEN 2 THEN 'wrong-object-type' ELSE 'file-not-found' END AS fault FROM ({PATHS})".replace("@DIV", "//"))
def resolve_path(spark, d):
    o, links, _ = parts(spark, d)
    files = links.where("target_type = 'blob' AND source LIKE 't:%'").select("repo_id", F.col("source").alias("tree"), turn("target").alias("pos"), F.concat(F.lit("f"), turn("target")).alias("name"), F.lit("100644").alias("mode"), F.col("target").alias("oid"))
    trees = o.where("type = 'tree'")
    folders = trees.select("repo_id", F.concat(F.lit("d:"), conv("oid")).alias("tree"), turn("oid").alias("pos"), F.concat(F.lit("t"), turn("oid")).alias("name"), F.lit(history.TREE).alias("mode"), "oid")
    stored = o.select("repo_id", "oid", "type").unionByName(folders.select("repo_id", F.col("tree").alias("oid"), F.lit("tree").alias("type")).distinct())
    return history.resolve_path(small(spark, d, PATHS).select("repo_id", "request", "tree", "path"), files.unionByName(folders), stored)


@query(f"""WITH h AS ({HEADS}), p AS (SELECT r.*, target AS peeled FROM fx_refs r LEFT JOIN fx_links l ON l.repo_id = r.repo_id AND l.source = r.oid AND r.oid LIKE 'g:%'),
t AS (SELECT repo_id, 1 AS part, name, oid || ' ' || name || coalesce(' peeled:' || peeled, '') || chr(10) AS text FROM p
  UNION ALL SELECT h.repo_id, 0, 'HEAD', coalesce(oid, 'unborn') || ' HEAD symref-target:' || target || chr(10) FROM h LEFT JOIN fx_refs r ON r.repo_id = h.repo_id AND r.name = h.target)
SELECT repo_id, part, name, {hex_line('text')} AS line FROM t UNION ALL SELECT repo_id, 2, '', lower(hex(encode('0000'))) FROM h""".replace("@DIV", "//"))
def ref_listing(spark, d):
    o, links, r = parts(spark, d)
    return wire.ref_lines(graph.peel(r, links, o), small(spark, d, HEADS)).withColumn("line", F.lower(F.hex("line")))


@query(f"""WITH {SCREEN}, a AS (SELECT *, CASE WHEN reason IS NULL AND bool_or(reason IS NOT NULL) OVER (PARTITION BY repo_id, push_id) THEN 'atomic push failure' ELSE reason END AS why FROM x),
t AS (SELECT repo_id, push_id, pos AS part, CASE WHEN why IS NULL THEN 'ok ' || name ELSE 'ng ' || name || ' ' || why END || chr(10) AS text FROM a UNION ALL SELECT DISTINCT repo_id, push_id, -1, 'unpack ok' || chr(10) FROM a)
SELECT repo_id, push_id, part, {hex_line('text')} AS line FROM t UNION ALL SELECT repo_id, push_id, max(pos) + 1, lower(hex(encode('0000'))) FROM a GROUP BY ALL""")
def push_report(spark, d):
    return wire.push_report(refs.atomic(one_push(spark, d)).withColumn("unpack", F.lit("ok"))).withColumn("line", F.lower(F.hex("line")))


@query("SELECT pos // 4 AS id, (pos % 4)::INT AS pos, old_oid, new_oid, name, CASE WHEN pos % 4 = 0 THEN 'report-status atomic' END AS capabilities, NULL::VARCHAR AS fault FROM fx_commands")
def push_requests(spark, d):
    c = fixture(spark, d, "fx_commands")
    text = F.concat_ws(" ", "old_oid", "new_oid", "name")
    text = F.when(F.col("pos") % 4 == 0, F.concat(text, F.lit("\u0000 report-status atomic"))).otherwise(text)
    bodies = c.select(F.expr("pos DIV 4").alias("id"), "pos", codec.pkt_line(F.concat(text, F.lit("\n"))).alias("line")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    bodies = bodies.select("id", F.concat(F.aggregate("lines", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["line"])), F.lit(wire.FLUSH).cast("binary")).alias("body"))
    return wire.push_commands(wire.frames(bodies)).withColumn("capabilities", F.array_join("capabilities", " "))


@query("SELECT name, rtrim(translate(base64(encode('{\"created_at\":\"' || created_at || '\",\"name\":\"' || name || '\"}')), '+/', '-_'), '=') AS page_cursor, created_at AS after_created_at, name AS after_name FROM fx_repositories")
def cursor_codec(spark, d):
    df = fixture(spark, d, "fx_repositories").select("name", wire.encode_cursor("created_at", "name").alias("page_cursor"))
    key = wire.decode_cursor(F.col("page_cursor"), "created_at string, name string")
    return df.select("name", "page_cursor", key["created_at"].alias("after_created_at"), key["name"].alias("after_name"))


@query("""WITH a AS (SELECT DISTINCT repo_id, name FROM fx_commands WHERE length(name) % 5 = repo_id % 5 AND NOT bogus),
n AS (SELECT repo_id, min(name) AS name FROM a GROUP BY repo_id HAVING count(*) = 1)
SELECT repo_id, substr(name, 12) AS branch FROM n WHERE repo_id % 4 <> 0 AND NOT (repo_id % 3 = 0 AND name = 'refs/heads/click')""")
def head_retarget(spark, d):
    c = fixture(spark, d, "fx_commands")
    accepted = c.where("length(name) % 5 = repo_id % 5 AND NOT bogus").select("repo_id", "name").distinct()
    held = c.where("repo_id % 4 = 0").select("repo_id", "name").distinct()
    at = c.select("repo_id").distinct().select("repo_id", F.when(F.col("repo_id") % 3 == 0, "refs/heads/click").otherwise("refs/heads/main").alias("target"))
    return refs.head_retarget(accepted, held, at)


@query("SELECT l.repo_id, l.source AS oid, o.type, o.size, list_sort(list(target))[1] AS first_target, count(*) AS targets FROM fx_links l JOIN fx_objects o ON o.repo_id = l.repo_id AND o.oid = l.source WHERE l.source LIKE 't:%' GROUP BY ALL")
def requested_metadata(spark, d):
    o, links, _ = parts(spark, d)
    asked = links.where("source LIKE 't:%'").groupBy("repo_id", F.col("source").alias("oid")).agg(F.min("target").alias("first_target"), F.count("*").alias("targets"))
    return asked.join(o.select("repo_id", "oid", "type", "size"), ["repo_id", "oid"])


@query(f"SELECT count(*) AS total, ((count(*) + 29) // 30)::BIGINT AS pages FROM fx_tokens WHERE revoked_at IS NULL AND expires_at_unix > {NOW}")
def token_page_totals(spark, d):
    live = fixture(spark, d, "fx_tokens").where(f"revoked_at IS NULL AND expires_at_unix > {NOW}")
    return live.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / 30))
