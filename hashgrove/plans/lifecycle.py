"""Registered queries over the life of objects, tokens and state tables, upkeep, negotiation and request texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashgrove.functions import codec, text, wire
from hashgrove.operators import graph, maintenance, negotiation, relational, state, store, tokens
from hashgrove.plans.bytes import BAD_COMMIT, BAD_TAG, BAD_TREE, stored
from hashgrove.plans.registry import SCREEN, TIPS, hex_line, parts, query, tips
from hashgrove.sources.fixtures import NOW, ZERO, fixture

SIZE = "octet_length(unhex(raw))"
#: A store derived from fx_bytes, in SQL of both engines: some objects incomplete, some not indexed, some not compressed, some with a delta.
STORE = f"SELECT repo_id, oid, type, CAST({SIZE} AS BIGINT) AS size, CAST(({SIZE} + 16383) @DIV 16384 AS BIGINT) AS chunks, CASE WHEN {SIZE} % 3 <> 0 THEN CAST({SIZE} @DIV 2 + 9 AS BIGINT) END AS compressed_size, CASE WHEN {SIZE} % 3 <> 0 THEN CAST(1 AS BIGINT) END AS compressed_chunks, {SIZE} % 7 <> 0 AS complete, {SIZE} % 5 <> 0 AS links_indexed FROM fx_bytes"
DELTAS = f"SELECT repo_id, oid, sha1(oid) AS base, CAST({SIZE} @DIV 4 + 3 AS BIGINT) AS size, CAST(1 AS BIGINT) AS chunks, CASE WHEN {SIZE} % 2 = 0 THEN CAST({SIZE} @DIV 5 + 11 AS BIGINT) END AS compressed_size, CASE WHEN {SIZE} % 2 = 0 THEN CAST(1 AS BIGINT) END AS compressed_chunks FROM fx_bytes WHERE {SIZE} % 4 = 1"
DUCK = {"st": STORE.replace("@DIV", "//"), "dl": DELTAS.replace("@DIV", "//")}


def table(spark: SparkSession, d: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("@DIV", "DIV").replace("FROM fx_bytes", "FROM {fx_bytes}"), fx_bytes=fixture(spark, d, "fx_bytes"))


def over(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({DUCK[n]})" for n in names)


@query(f"{over('st')} SELECT b.repo_id, b.oid, CASE WHEN s.oid IS NOT NULL AND s.complete THEN 'kept' ELSE 'written' END AS outcome FROM fx_bytes b LEFT JOIN st s ON s.repo_id = b.repo_id AND s.oid = b.oid AND s.size % 2 = 0")
def publish_outcomes(spark, d):
    outcomes, _, _ = store.publish(stored(spark, d).withColumn("pos", F.lit(0)), table(spark, d, STORE).where("size % 2 = 0"))
    return outcomes.select("repo_id", "oid", "outcome")


FAULTY = f"(SELECT sha1('t:' || conv_id || ':' || turn) AS oid FROM conversations WHERE {BAD_TREE} UNION ALL SELECT sha1('g:' || conv_id) FROM conversations WHERE {BAD_TAG})"


@query(f"{over('st')} SELECT s.repo_id, s.oid, s.type, s.size, s.chunks, true AS complete, CASE WHEN s.size % 2 = 0 AND s.complete THEN s.links_indexed ELSE s.oid NOT IN {FAULTY} END AS links_indexed FROM st s")
def publish_objects(spark, d):
    _, after, _ = store.publish(stored(spark, d).withColumn("pos", F.lit(0)), table(spark, d, STORE).where("size % 2 = 0"))
    return after.select("repo_id", "oid", "type", "size", "chunks", "complete", "links_indexed")


@query(f"""{over('st', 'dl')}, g AS (SELECT s.*, coalesce(s.chunks, 0) + coalesce(s.compressed_chunks, 0) + coalesce(l.chunks, 0) + coalesce(l.compressed_chunks, 0) AS c, coalesce(s.size, 0) + coalesce(s.compressed_size, 0) + coalesce(l.size, 0) + coalesce(l.compressed_size, 0) AS b FROM st s LEFT JOIN dl l ON l.repo_id = s.repo_id AND l.oid = s.oid WHERE s.type = 'blob')
SELECT repo_id, count(*) AS objects, sum(c)::BIGINT AS chunks, sum(b)::BIGINT AS bytes FROM g GROUP BY repo_id""")
def reclaim_totals(spark, d):
    objects, deltas = table(spark, d, STORE), table(spark, d, DELTAS)
    gone = objects.where("type = 'blob'").select("repo_id", "oid").unionByName(objects.select("repo_id", F.concat(F.lit("x"), "oid").alias("oid")))
    return store.reclaim(gone, objects, deltas, fixture(spark, d, "fx_links"), store.pieces(stored(spark, d)))[0]


@query(f"{over('st')}, p AS (SELECT repo_id, oid, unnest(range(chunks)) AS idx FROM st WHERE type <> 'blob') SELECT repo_id, oid, idx::INT AS idx FROM p")
def reclaim_pieces(spark, d):
    objects = table(spark, d, STORE)
    return store.reclaim(objects.where("type = 'blob'"), objects, table(spark, d, DELTAS), fixture(spark, d, "fx_links"), store.pieces(stored(spark, d)))[4].select("repo_id", "oid", "idx")


@query(f"{over('st')} SELECT repo_id, oid, links_indexed OR (complete AND oid NOT IN {FAULTY}) AS links_indexed FROM st")
def backfill_links(spark, d):
    links = stored(spark, d).limit(0).select("repo_id", F.col("oid").alias("source"), F.col("type").alias("source_type"), F.lit(0).alias("pos"), F.col("oid").alias("target"), F.col("type").alias("target_type"))
    return store.backfill_links(table(spark, d, STORE), stored(spark, d), links)[0].select("repo_id", "oid", "links_indexed")


@query(f"{over('st', 'dl')} SELECT repo_id, oid, base, size FROM dl UNION ALL SELECT repo_id, oid, 'new', 1 FROM st WHERE type = 'tree' AND (repo_id, oid) NOT IN (SELECT (repo_id, oid) FROM dl)")
def install_deltas(spark, d):
    trees, one = table(spark, d, STORE).where("type = 'tree'"), F.lit(1).cast("long")
    new = lambda base, pos: trees.select("repo_id", "oid", F.lit(base).alias("base"), one.alias("size"), one.alias("chunks"), one.alias("compressed_size"), one.alias("compressed_chunks"), F.lit(pos).alias("pos"))
    return store.install_deltas(new("new", 0).unionByName(new("later", 1)), table(spark, d, DELTAS)).select("repo_id", "oid", "base", "size")


@query(f"{over('st')} SELECT repo_id, oid, compressed_size IS NOT NULL OR complete AS held, CASE WHEN compressed_size IS NOT NULL THEN compressed_size END AS old_size FROM st")
def ensure_compressed(spark, d):
    objects = table(spark, d, STORE)
    after = store.ensure_compressed(objects, stored(spark, d)).select("repo_id", "oid", (F.col("compressed_size") > 0).alias("held"))
    return after.join(objects.select("repo_id", "oid", F.col("compressed_size").alias("old_size")), ["repo_id", "oid"]).withColumn("held", F.coalesce("held", F.lit(False)))


@query(f"{over('st', 'dl')} SELECT s.repo_id, s.oid, s.type, s.size, s.chunks, l.base, l.size AS delta_size FROM st s LEFT JOIN dl l ON l.repo_id = s.repo_id AND l.oid = s.oid WHERE complete")
def object_metadata(spark, d):
    return store.metadata(stored(spark, d), table(spark, d, STORE), table(spark, d, DELTAS))


@query(f"{over('st', 'dl')} SELECT l.repo_id, l.oid, l.base FROM dl l JOIN st s ON s.repo_id = l.repo_id AND s.oid = l.oid WHERE complete")
def delta_bases(spark, d):
    return store.delta_bases(table(spark, d, STORE), table(spark, d, DELTAS))


@query(f"""{over('st')}, r AS (SELECT s.repo_id, s.oid, CASE WHEN size % 11 = 0 THEN 'tag' ELSE type END AS type, CASE WHEN NOT complete THEN 'not-found' WHEN size % 11 = 0 AND type <> 'tag' THEN 'wrong-type' WHEN size % 13 = 1 AND size > 0 THEN 'missing-chunk' WHEN size % 13 = 2 THEN 'over-run' WHEN size % 13 = 3 THEN 'under-run' END AS fault FROM st s)
SELECT r.*, CASE WHEN fault IS NULL THEN md5(unhex(raw)) END AS digest FROM r JOIN fx_bytes b ON b.repo_id = r.repo_id AND b.oid = r.oid""")
def read_objects(spark, d):
    """Every object read from its pieces; some ask for another type, some have pieces that are gone, too long or too short."""
    objects, k = table(spark, d, STORE), F.octet_length("bytes") % 13
    found = store.pieces(stored(spark, d)).join(objects.select("repo_id", "oid", "size"), ["repo_id", "oid"]).where("NOT (size % 13 = 1 AND idx = 0)")
    k = F.col("size") % 13
    body = F.when((k == 2) & (F.col("idx") == 0), F.concat("bytes", F.lit("x").cast("binary"))).when((k == 3) & (F.col("idx") == 0), F.substr("bytes", F.lit(2), F.lit(1 << 20))).otherwise(F.col("bytes"))
    asked = objects.select("repo_id", "oid", F.when(F.col("size") % 11 == 0, "tag").otherwise(F.col("type")).alias("type"))
    return store.read_whole(asked, objects, found.withColumn("bytes", body)).select("repo_id", "oid", "type", "fault", F.md5("bytes").alias("digest"))


@query("SELECT doc_id, md5(text) AS digest, NULL::VARCHAR AS fault FROM fx_blobs")
def object_rejoin(spark, d):
    blobs = fixture(spark, d, "fx_blobs").select(F.lit(0).cast("long").alias("repo_id"), F.col("doc_id").cast("string").alias("oid"), "size", F.col("text").cast("binary").alias("bytes"))
    objects = blobs.select("repo_id", "oid", F.lit("blob").alias("type"), "size", store.chunk_count(F.col("size")).alias("chunks"), F.lit(True).alias("complete"))
    return store.read_whole(objects.select("repo_id", "oid", "type"), objects, store.pieces(blobs)).select(F.col("oid").cast("long").alias("doc_id"), F.md5("bytes").alias("digest"), "fault")


OWNED = "SELECT id, 'nation-' || (owner % 25) AS namespace_slug, 'repo-' || (owner % 97) AS repository_name, scope, sha1('s:' || id) AS secret, created_at, expires_at_unix, revoked_at FROM fx_tokens"


def owned(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(OWNED.replace("FROM fx_tokens", "FROM {t}"), t=fixture(spark, d, "fx_tokens"))
    return rows.withColumn("secret_hash", tokens.digest(F.col("secret")))


@query(f"""WITH t AS ({OWNED}) SELECT id, CASE WHEN namespace_slug = 'nation-3' THEN 'repository-missing' ELSE 'created' END AS outcome, CASE WHEN namespace_slug <> 'nation-3' THEN sha256(secret) END AS secret_hash, CASE WHEN namespace_slug <> 'nation-3' THEN {NOW} + 86400 END::BIGINT AS expires_at_unix,
CASE WHEN namespace_slug <> 'nation-3' THEN 'art_v1_' || secret || '?expires=' || ({NOW} + 86400) END AS plaintext FROM t""")
def token_create(spark, d):
    t = owned(spark, d)
    known = t.where("namespace_slug <> 'nation-3'").select("namespace_slug", F.col("repository_name").alias("name")).distinct()
    return tokens.create(t.withColumn("ttl", F.lit(tokens.TTL)), known, NOW).select("id", "outcome", "secret_hash", "expires_at_unix", "plaintext")


@query(f"""WITH t AS ({OWNED}), h AS (SELECT *, ('0x' || substr(id, 1, 2))::INT % 5 AS k FROM t)
SELECT id, CASE WHEN k IN (0, 2, 3) THEN 'now' ELSE revoked_at END AS revoked_at FROM h""")
def token_revoke(spark, d):
    """One in five is revoked by id, one by a whole token, one by the id in its repository; others are named under a wrong namespace, or not at all."""
    t = owned(spark, d)
    k = F.conv(F.substr("id", F.lit(1), F.lit(2)), 16, 10).cast("int") % 5
    whole = tokens.plaintext(F.col("secret"), F.col("expires_at_unix"))
    commands = t.withColumn("k", k).where("k <> 4").select(F.concat(F.lit("c"), "id").alias("command"), F.when(F.col("k") == 1, "elsewhere").otherwise(F.col("namespace_slug")).alias("namespace_slug"), F.when(F.col("k") != 0, F.col("repository_name")).alias("repository_name"), F.when(F.col("k") == 2, whole).otherwise(F.col("id")).alias("token"))
    return tokens.revoke(t.drop("secret"), commands, "now")[0].select("id", "revoked_at")


@query(f"""WITH t AS ({OWNED}), q AS (SELECT *, ('0x' || substr(id, 1, 2))::INT % 6 AS k, ('0x' || substr(id, 3, 2))::INT % 2 = 0 AS writes FROM t)
SELECT id AS request, k IN (0, 1) AND revoked_at IS NULL AND expires_at_unix > {NOW} AND (NOT writes OR scope = 'write') AS allowed FROM q""")
def token_checks(spark, d):
    """Requests with: the whole token, its secret part alone, another expiry, another repository, another secret, no token."""
    t = owned(spark, d).withColumns({"k": F.conv(F.substr("id", F.lit(1), F.lit(2)), 16, 10).cast("int") % 6, "scope": F.when(F.conv(F.substr("id", F.lit(3), F.lit(2)), 16, 10).cast("int") % 2 == 0, "write").otherwise("read")})
    whole = tokens.plaintext(F.col("secret"), F.col("expires_at_unix"))
    shown = (F.when(F.col("k") == 1, F.concat(F.lit(tokens.PREFIX), "secret")).when(F.col("k") == 2, tokens.plaintext(F.col("secret"), F.col("expires_at_unix") + 1)).when(F.col("k") == 4, tokens.plaintext(F.sha1("secret"), F.col("expires_at_unix"))).when(F.col("k") == 5, "Bearer").otherwise(whole))
    asked = t.select(F.col("id").alias("request"), shown.alias("presented"), "namespace_slug", F.when(F.col("k") == 3, "other").otherwise(F.col("repository_name")).alias("repository_name"), "scope")
    return tokens.authorize(asked, owned(spark, d), NOW)


MOVES = "SELECT repo_id, name, new_oid, pos FROM fx_commands WHERE NOT bogus"


@query("SELECT repo_id, name, CASE WHEN max(pos) FILTER (NOT bogus) IS NULL THEN 'old' ELSE max_by(new_oid, pos) FILTER (NOT bogus) END AS oid FROM fx_commands GROUP BY ALL")
def refs_upsert(spark, d):
    c = fixture(spark, d, "fx_commands")
    current = c.select("repo_id", "name").distinct().withColumn("oid", F.lit("old"))
    return state.upsert(current, c.where("NOT bogus").select("repo_id", "name", F.col("new_oid").alias("oid"), "pos"), ["repo_id", "name"], "pos")


@query("SELECT repo_id, oid, CASE WHEN oid LIKE 'b:%:1' THEN 'first' ELSE min(target_type) END AS expected_type FROM (SELECT repo_id, target AS oid, target_type FROM fx_links UNION ALL SELECT repo_id, oid, NULL FROM fx_refs) GROUP BY repo_id, oid")
def expected_types(spark, d):
    _, links, r = parts(spark, d)
    named = links.select("repo_id", F.col("target").alias("oid"), F.col("target_type").alias("expected_type")).unionByName(r.select("repo_id", "oid", F.lit(None).cast("string").alias("expected_type")))
    current = named.select("repo_id", "oid").distinct().withColumn("expected_type", F.when(F.col("oid").rlike("^b:.*:1$"), "first"))
    return state.upsert_known(current, named.withColumn("at", F.monotonically_increasing_id()), ["repo_id", "oid"], "expected_type", "at")


REPOS = "SELECT namespace_slug, name, id, CASE WHEN length(name) + CAST(substr(id, 6) AS INT) % 3 > 19 THEN 'importing' WHEN read_only THEN 'forking' ELSE 'ready' END AS status, last_push_at, CASE WHEN read_only THEN 'main' ELSE 'trunk' END AS default_branch FROM fx_repositories"
ODD = "CAST(substr(id, 6) AS INT) % 2 = 1"


def repos(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(REPOS.replace("FROM fx_repositories", "FROM {r}"), r=fixture(spark, d, "fx_repositories"))


@query(f"WITH r AS ({REPOS}) SELECT namespace_slug, name, CASE WHEN status = 'importing' AND {ODD} THEN 'ready' ELSE status END AS status, CASE WHEN status = 'importing' AND {ODD} THEN 'imported' ELSE default_branch END AS default_branch FROM r")
def finish_imports(spark, d):
    """Every repository is told to publish its import, half of them under an id that is not theirs."""
    r = repos(spark, d)
    asked = r.select("namespace_slug", "name", F.when(F.expr(ODD), F.col("id")).otherwise(F.lit("stale")).alias("id"), F.lit("importing").alias("status"), F.lit("ready").alias("to"), F.lit("imported").alias("branch"))
    return state.compare_and_set(r, asked, ["namespace_slug", "name"], ["id", "status"], {"status": "to", "default_branch": "branch"})[0].select("namespace_slug", "name", "status", "default_branch")


@query(f"WITH r AS ({REPOS}) SELECT namespace_slug, name, id FROM r WHERE status = 'importing' AND {ODD}")
def delete_owned_imports(spark, d):
    r = repos(spark, d)
    asked = r.select("namespace_slug", "name", F.when(F.expr(ODD), F.col("id")).otherwise(F.lit("stale")).alias("id"), F.lit("importing").alias("status"))
    return state.delete_returning(r, asked, ["namespace_slug", "name"], ["id", "status"])[1].select("namespace_slug", "name", "id")


@query(f"WITH r AS ({REPOS}) SELECT namespace_slug, name, CASE WHEN {ODD} THEN 'pushed' ELSE last_push_at END AS last_push_at, CASE WHEN {ODD} AND status = 'ready' THEN 'new' ELSE default_branch END AS default_branch FROM r")
def record_pushes(spark, d):
    r = repos(spark, d)
    stamps = r.where(ODD).select("namespace_slug", "name", F.lit("pushed").alias("pushed_at"), F.when(F.col("status") == "ready", "new").alias("branch"))
    return state.record_pushes(r, stamps).select("namespace_slug", "name", "last_push_at", "default_branch")


PUSHED = f"SELECT repo_id, name, pos, CASE WHEN pos % 4 = 0 THEN '{ZERO}' ELSE new_oid END AS new_oid FROM fx_commands WHERE NOT bogus AND repo_id % 3 <> 0"


@query(f"""WITH p AS ({PUSHED}), c AS (SELECT repo_id, name, max_by(new_oid, pos) AS oid FROM p GROUP BY ALL), h AS (SELECT repo_id, name, 'kept' AS oid FROM fx_commands WHERE repo_id % 2 = 0 GROUP BY ALL)
SELECT v.repo_id, CASE WHEN v.repo_id % 3 <> 0 AND EXISTS (SELECT 1 FROM p WHERE p.repo_id = v.repo_id) THEN 8 ELSE 7 END::BIGINT AS ref_version,
(SELECT count(*) FROM (SELECT repo_id, name FROM h WHERE (repo_id, name) NOT IN (SELECT (repo_id, name) FROM c) UNION ALL SELECT repo_id, name FROM c WHERE oid <> '{ZERO}') x WHERE x.repo_id = v.repo_id) AS refs FROM (SELECT DISTINCT repo_id FROM fx_commands) v""")
def apply_pushes(spark, d):
    c = fixture(spark, d, "fx_commands")
    held = c.where("repo_id % 2 = 0").select("repo_id", "name").distinct().withColumn("oid", F.lit("kept"))
    repo = c.select("repo_id").distinct()
    pushed = spark.sql(PUSHED.replace("FROM fx_commands", "FROM {c}"), c=c)
    refs_, _, versions = state.apply_pushes(held, repo.selectExpr("repo_id", "'symbolic' AS kind", "'refs/heads/main' AS target"), repo.selectExpr("repo_id", "7L AS ref_version"), pushed)
    return versions.join(refs_.groupBy("repo_id").agg(F.count("*").alias("refs")), "repo_id", "left").select("repo_id", "ref_version", F.coalesce("refs", F.lit(0)).alias("refs"))


@query("""WITH i AS (SELECT repo_id, min(oid) AS oid FROM fx_refs WHERE name LIKE 'refs/heads/%' AND repo_id % 2 = 0 GROUP BY repo_id)
SELECT repo_id, name, oid FROM fx_refs WHERE repo_id NOT IN (SELECT repo_id FROM i) UNION ALL SELECT repo_id, 'refs/heads/main', oid FROM i""")
def import_branches(spark, d):
    o, _, r = parts(spark, d)
    imports = r.where("name LIKE 'refs/heads/%' AND repo_id % 2 = 0").groupBy("repo_id").agg(F.min("oid").alias("oid")).withColumn("branch", F.lit("main"))
    repo = r.select("repo_id").distinct()
    return state.import_branches(r, o.limit(0).select("repo_id", "oid"), repo.selectExpr("repo_id", "'symbolic' AS kind", "'x' AS target"), repo.selectExpr("repo_id", "1L AS ref_version"), imports, o.select("repo_id", "oid"), o)[0]


@query("SELECT repo_id, oid FROM fx_objects WHERE type = 'commit' AND repo_id % 2 = 0 UNION ALL SELECT repo_id, oid FROM fx_objects WHERE oid LIKE 'c:%:0' AND repo_id % 2 <> 0")
def import_boundaries(spark, d):
    o, _, r = parts(spark, d)
    imports = r.where("name LIKE 'refs/heads/%' AND repo_id % 2 = 0").groupBy("repo_id").agg(F.min("oid").alias("oid")).withColumn("branch", F.lit("main"))
    repo = r.select("repo_id").distinct()
    old = o.where("oid LIKE 'c:%:0'").select("repo_id", "oid")
    return state.import_branches(r, old, repo.selectExpr("repo_id", "'symbolic' AS kind", "'x' AS target"), repo.selectExpr("repo_id", "1L AS ref_version"), imports, o.select("repo_id", "oid"), o)[1]


@query("SELECT repo_id, count(*) AS objects FROM fx_objects WHERE repo_id % 2 <> 0 GROUP BY repo_id")
def drop_repositories(spark, d):
    o, _, r = parts(spark, d)
    return state.drop_repositories(r.where("repo_id % 2 = 0"), o)[0].groupBy("repo_id").agg(F.count("*").alias("objects"))


@query("SELECT repo_id, array_to_string(list_sort(list(DISTINCT oid)), ',') AS oids FROM (SELECT repo_id, oid FROM fx_objects WHERE oid LIKE 'c:%:0' UNION ALL SELECT repo_id, oid FROM fx_refs WHERE oid LIKE 'c:%') GROUP BY repo_id")
def shallow_lists(spark, d):
    o, _, r = parts(spark, d)
    return state.shallow_lists(state.boundaries(o.where("oid LIKE 'c:%:0'"), r.where("oid LIKE 'c:%'"))).withColumn("oids", F.array_join("oids", ","))


STATES = "SELECT id AS repo_id, CASE id % 4 WHEN 0 THEN 'mark' WHEN 1 THEN 'sweep' WHEN 2 THEN 'complete' END AS phase, CAST(id % 3 AS BIGINT) AS ref_version, CAST(id % 5 AS BIGINT) AS now_version, CAST(id * 10 AS BIGINT) AS n FROM (SELECT CAST(c_custkey AS BIGINT) AS id FROM customer)"


@query(f"""WITH s AS ({STATES}) SELECT repo_id, CASE WHEN phase IS NULL OR phase = 'complete' OR ref_version <> now_version THEN 'mark' ELSE phase END AS phase, now_version AS ref_version, CASE WHEN phase IS NULL OR phase = 'complete' THEN 'now' ELSE 'then' END AS started_at,
CASE WHEN phase IS NULL OR phase = 'complete' OR ref_version <> now_version THEN 0 ELSE n END AS reachable, CASE WHEN phase IS NULL OR phase = 'complete' THEN 0 ELSE n + 1 END AS reclaimed_objects FROM s""")
def sweep_checkpoint(spark, d):
    s = spark.sql(STATES.replace("FROM customer", "FROM {c}"), c=spark.read.parquet(f"{d}/customer.parquet"))
    states = s.where("phase IS NOT NULL").selectExpr("repo_id", "phase", "ref_version", "'then' AS started_at", "CAST(NULL AS STRING) AS completed_at", "n AS reachable", "n + 1 AS reclaimed_objects", "n AS reclaimed_chunks", "n AS reclaimed_bytes")
    return maintenance.sweep_checkpoint(states, s.select("repo_id", F.col("now_version").alias("ref_version")), "now").select("repo_id", "phase", "ref_version", "started_at", "reachable", "reclaimed_objects")


@query(f"""WITH s AS (SELECT *, CASE WHEN n % 20 = 0 THEN now_version END AS repacked, CASE WHEN n % 40 = 0 THEN 'at' END AS done FROM ({STATES})), w AS (SELECT *, coalesce(phase = 'complete' AND ref_version = now_version, false) AS swept FROM s)
SELECT repo_id, CASE WHEN NOT swept THEN 'waiting' WHEN repacked IS NOT NULL AND done IS NOT NULL THEN 'complete' ELSE 'select' END AS phase, CASE WHEN swept AND NOT (repacked IS NOT NULL AND done IS NOT NULL) THEN 'repack' ELSE 'sweep' END AS step FROM w""")
def upkeep_step(spark, d):
    s = spark.sql(STATES.replace("FROM customer", "FROM {c}"), c=spark.read.parquet(f"{d}/customer.parquet"))
    s = s.selectExpr("repo_id", "now_version AS ref_version", "phase AS sweep_phase", "ref_version AS sweep_version", "CASE WHEN n % 20 = 0 THEN now_version END AS repack_version", "CASE WHEN n % 40 = 0 THEN 'at' END AS repack_completed_at")
    return s.select("repo_id", maintenance.repack_phase().alias("phase"), maintenance.next_step().alias("step"))


@query("""WITH b AS (SELECT repo_id, oid, row_number() OVER (PARTITION BY repo_id ORDER BY oid) AS k FROM fx_objects WHERE repo_id % 3 = 0 OR oid > 'c:'),
x AS (SELECT repo_id, max(oid) AS last, count(*) AS n FROM b WHERE k <= 64 GROUP BY repo_id) SELECT repo_id, last AS "cursor", n < 64 AS complete FROM x""")
def sweep_batch(spark, d):
    o = fixture(spark, d, "fx_objects")
    cursors = o.select("repo_id").distinct().withColumn("cursor", F.when(F.col("repo_id") % 3 != 0, "c:"))
    return maintenance.advance(maintenance.next_batch(o, cursors, maintenance.SWEEP_BATCH), cursors, maintenance.SWEEP_BATCH)


@query("SELECT repo_id, pos AS step, sum(n) OVER w AS total_objects, sum(n * 2) OVER w AS total_chunks, sum(n * 3) OVER w AS total_bytes FROM (SELECT repo_id, pos, length(name) AS n FROM fx_commands) WINDOW w AS (PARTITION BY repo_id ORDER BY pos)".replace("sum(n)", "sum(n)::BIGINT").replace("sum(n)::BIGINT OVER w", "(sum(n) OVER w)::BIGINT").replace("sum(n * 2) OVER w", "(sum(n * 2) OVER w)::BIGINT").replace("sum(n * 3) OVER w", "(sum(n * 3) OVER w)::BIGINT"))
def sweep_running_totals(spark, d):
    c = fixture(spark, d, "fx_commands")
    n = F.length("name")
    return maintenance.sweep_totals(c.select("repo_id", F.col("pos").alias("step"), n.alias("objects"), (n * 2).alias("chunks"), (n * 3).alias("bytes")))


JOB = "SELECT user_id AS job, event_id AS pos, CASE event_type WHEN 'view' THEN 'unavailable' WHEN 'click' THEN 'imported' WHEN 'purchase' THEN 'published' WHEN 'signup' THEN 'failed' ELSE 'cleaned' END AS event FROM events"


@query(f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY pos) AS k FROM ({JOB})),
r(job, k, attempts, state) AS (SELECT DISTINCT job, 0::BIGINT, 0, 'running' FROM e UNION ALL SELECT r.job, e.k, CASE WHEN state = 'running' AND event IN ('imported', 'unavailable', 'failed') THEN attempts + 1 ELSE attempts END,
  CASE WHEN state = 'running' THEN CASE event WHEN 'imported' THEN 'imported' WHEN 'failed' THEN 'failed' WHEN 'unavailable' THEN CASE WHEN attempts + 1 < 3 THEN 'running' ELSE 'failed' END ELSE state END
  WHEN state = 'imported' AND event = 'published' THEN 'done' WHEN state = 'failed' AND event = 'cleaned' THEN 'removed' ELSE state END FROM r JOIN e ON e.job = r.job AND e.k = r.k + 1)
SELECT job, max_by(attempts, k)::INT AS attempts, max_by(state, k) AS state FROM r GROUP BY job""".replace("WITH e AS", "WITH RECURSIVE e AS"))
def import_jobs(spark, d):
    return maintenance.import_jobs(spark.sql(JOB.replace("FROM events", "FROM {e}"), e=spark.read.parquet(f"{d}/events.parquet")))


@query(f"WITH w AS ({TIPS} UNION ALL SELECT repo_id, 'x' || oid FROM fx_refs WHERE repo_id % 3 = 0) SELECT repo_id AS request, {hex_line('text')} AS line FROM (SELECT repo_id, 'ERR upload-pack: not our ref ' || min(oid) || chr(10) AS text FROM w WHERE (repo_id, oid) NOT IN (SELECT (repo_id, oid) FROM fx_refs) GROUP BY repo_id)")
def refused_wants(spark, d):
    r = parts(spark, d)[2]
    wants = tips(r).unionByName(r.where("repo_id % 3 = 0").select("repo_id", F.concat(F.lit("x"), "oid").alias("oid"))).withColumn("request", F.col("repo_id"))
    return negotiation.refused(wants.withColumn("pos", F.col("oid")), r).withColumn("line", F.lower(F.hex("line")))


@query(f"""WITH h AS (SELECT repo_id, oid, row_number() OVER (PARTITION BY repo_id ORDER BY oid) AS pos FROM fx_objects WHERE type = 'commit'), c AS (SELECT * FROM h WHERE pos % 3 <> 0), q AS (SELECT DISTINCT repo_id, repo_id % 3 = 0 AS done, repo_id % 2 = 0 AS detailed FROM fx_objects), l AS (SELECT repo_id, max_by(oid, pos) AS oid, max(pos) AS pos FROM c GROUP BY repo_id),
t AS (SELECT c.repo_id, c.pos AS part, 'ACK ' || oid || ' common' || chr(10) AS text FROM c JOIN q USING (repo_id) WHERE NOT done AND detailed UNION ALL SELECT repo_id, coalesce(l.pos, -1) + 1, CASE WHEN (NOT done AND detailed) OR l.oid IS NULL THEN 'NAK' ELSE 'ACK ' || l.oid END || chr(10) FROM q LEFT JOIN l USING (repo_id))
SELECT repo_id AS request, part, {hex_line('text')} AS line FROM t""")
def acknowledgements(spark, d):
    o = fixture(spark, d, "fx_objects").where("type = 'commit'").withColumn("pos", F.expr("row_number() OVER (PARTITION BY repo_id ORDER BY oid)"))
    haves = o.select(F.col("repo_id").alias("request"), "repo_id", "pos", "oid")
    asked = fixture(spark, d, "fx_objects").select(F.col("repo_id").alias("request"), (F.col("repo_id") % 3 == 0).alias("done"), (F.col("repo_id") % 2 == 0).alias("detailed")).distinct()
    return negotiation.acknowledgements(asked, negotiation.common(haves, o.withColumn("complete", F.col("pos") % 3 != 0))).withColumn("line", F.lower(F.hex("line")))


@query(f"""WITH e AS (SELECT * FROM fx_links WHERE target_type = 'commit' AND source_type = 'commit'), s AS (SELECT repo_id, oid FROM fx_objects WHERE oid LIKE 'c:%7:2'),
w AS (SELECT repo_id, oid, 1 AS depth FROM ({TIPS}) UNION SELECT e.repo_id, target, depth + 1 FROM w JOIN e ON e.repo_id = w.repo_id AND e.source = w.oid WHERE depth < 6 AND (w.repo_id, w.oid) NOT IN (SELECT (repo_id, oid) FROM s)),
m AS (SELECT repo_id, oid, min(depth) AS depth FROM w GROUP BY ALL), p AS (SELECT *, (repo_id, oid) IN (SELECT (repo_id, oid) FROM s) OR (depth = 6 AND (repo_id, oid) IN (SELECT (repo_id, source) FROM e)) AS shallow FROM m),
t AS (SELECT repo_id, 0 AS part, oid, 'shallow ' || oid || chr(10) AS text FROM p WHERE shallow UNION ALL SELECT repo_id, 1, oid, 'unshallow ' || oid || chr(10) FROM p WHERE NOT shallow AND oid LIKE 'c:%:3')
SELECT repo_id, part, oid, {hex_line('text')} AS line FROM t UNION ALL SELECT DISTINCT repo_id, 2, '', lower(hex(encode('0000'))) FROM p""")
def shallow_updates(spark, d):
    o, links, r = parts(spark, d)
    plan = graph.depth_plan(links, tips(r), 6, repository_shallow=o.where("oid LIKE 'c:%7:2'"), client_shallow=o.where("oid LIKE 'c:%:3'"))
    return negotiation.shallow_lines(plan).withColumn("line", F.lower(F.hex("line")))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'symbolic' WHEN 1 THEN 'detached' WHEN 2 THEN 'symbolic' END AS kind, CASE turn % 4 WHEN 0 THEN 'refs/heads/' || role WHEN 1 THEN sha1(role) WHEN 2 THEN 'refs/x/' || role END AS target, CASE turn % 4 WHEN 0 THEN role END AS branch,
CASE turn % 4 WHEN 0 THEN 'ref: refs/heads/' || role || chr(10) WHEN 1 THEN sha1(role) || chr(10) WHEN 2 THEN 'ref: refs/x/' || role || chr(10) END AS file FROM conversations""")
def head_files(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").withColumn("k", F.col("turn") % 4)
    raw = F.when(F.col("k") == 0, F.concat(F.lit("  ref:refs/heads/"), "role")).when(F.col("k") == 1, F.concat(F.sha1("role"), F.lit("\n"))).when(F.col("k") == 2, F.concat(F.lit("ref: \t refs/x/"), "role")).otherwise(F.lit("ref: "))
    h = text.parsed_head(raw)
    return c.select("conv_id", "turn", h["kind"].alias("kind"), h["target"].alias("target"), h["branch"].alias("branch"), F.when(h.isNotNull(), text.head_file(h["kind"], h["target"])).alias("file"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN role WHEN 1 THEN role || ':x' END AS credential FROM conversations")
def credentials(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    k, basic = F.col("turn") % 4, lambda t: F.base64(t.cast("binary"))
    header = F.when(k == 0, F.concat(F.lit("bearer  "), "role")).when(k == 1, F.concat(F.lit("Basic "), basic(F.concat(F.lit("user:"), "role", F.lit(":x"))))).when(k == 2, F.concat(F.lit("Basic "), basic(F.concat(F.lit(":"), "role")))).otherwise("Digest x")
    return c.select("conv_id", "turn", text.credential(header).alias("credential"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/]+') THEN 'git:' || regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', ''), '\\.git$', '') || '.git' END AS source FROM pages WHERE regexp_matches(url, '^https?://[a-z0-9.-]+/[^/]')")
def import_sources(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").where("url RLIKE '^https?://[a-z0-9.-]+/[^/]'")
    return p.select("page_id", text.import_source(F.concat("url", F.when(F.col("page_id") % 2 == 0, "?token=x#y").otherwise(""))).alias("source"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 <> 2 AND doc_id % 2 = 0 THEN 'n' || doc_id END AS name, CASE WHEN doc_id % 3 <> 2 AND doc_id % 2 = 0 THEN doc_id % 4 = 0 END AS read_only, CASE WHEN doc_id % 3 = 2 THEN 'malformed' WHEN doc_id % 2 = 1 THEN 'type' END AS fault FROM documents""")
def json_bodies(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    flag = F.when(F.col("doc_id") % 2 == 1, F.lit("\"true\"")).otherwise((F.col("doc_id") % 4 == 0).cast("string"))
    body = F.concat(F.lit("{\"name\": \"n"), F.col("doc_id"), F.lit("\", \"x\": [1], \"read_only\": "), flag, F.when(F.col("doc_id") % 3 == 2, "").otherwise("}"))
    got = text.strict_json(body, {"name": "string", "read_only": "boolean"})
    return docs.withColumn("got", got).select("doc_id", "got.value.name", "got.value.read_only", "got.fault")


@query("SELECT c_custkey AS id, '{\"errors\":[],\"messages\":[],\"result\":{\"name\":\"' || c_name || '\",\"description\":null},\"success\":true,\"result_info\":{\"count\":1}}' AS body FROM customer")
def envelopes(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select(F.col("c_custkey").alias("id"), text.envelope(F.struct(F.col("c_name").alias("name"), F.lit(None).cast("string").alias("description")), result_info=F.struct(F.lit(1).alias("count"))).alias("body"))


@query(f"""WITH {SCREEN} SELECT repo_id, name, pos, CASE WHEN push_id % 7 = 0 THEN 'n/a (unpacker error)' WHEN reason IS NULL AND pos % 9 = 1 THEN 'missing necessary objects' ELSE reason END AS reason FROM x""")
def push_unpacked(spark, d):
    from hashgrove.operators import refs

    c = fixture(spark, d, "fx_commands")
    held = c.where("pos % 7 < 4 AND NOT bogus").groupBy("repo_id", "name").agg(F.max_by("new_oid", "pos").alias("oid"))
    rows = c.withColumn("push_id", F.expr("pos DIV 40"))
    lacks, failed = c.where("pos % 9 = 1").select("repo_id", F.col("new_oid").alias("oid")), rows.where("push_id % 7 = 0").select("repo_id", "push_id")
    return refs.screen(rows, held, lacks, failed).select("repo_id", "name", "pos", "reason")


@query("SELECT k AS request, o.repo_id, o.oid, o.type, o.size FROM (SELECT repo_id % 7 AS k, repo_id, oid FROM fx_objects WHERE type IN ('commit', 'tag')) r JOIN fx_objects o ON o.repo_id = r.repo_id AND o.oid = r.oid")
def requested_list(spark, d):
    """Each request names its objects in one JSON array, which becomes rows and is joined."""
    o = fixture(spark, d, "fx_objects")
    lists = o.where("type IN ('commit', 'tag')").groupBy((F.col("repo_id") % 7).alias("request"), "repo_id").agg(F.to_json(F.collect_list("oid")).alias("list"))
    asked = lists.select("request", "repo_id", F.explode(F.from_json("list", "array<string>")).alias("oid"))
    return asked.join(o, ["repo_id", "oid"]).select("request", "repo_id", "oid", "type", "size")


@query("""SELECT page_id, 'dir a/' || page_id || '+b.' || CASE page_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'json' ELSE 'none9' END AS path, CASE WHEN page_id % 5 = 0 THEN 'malformed' END AS fault,
CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/json' ELSE 'application/octet-stream' END AS media, 'https://h:1/git/ns/r' || page_id || '.git' AS remote FROM pages""".replace("SELECT page_id, 'dir a/' || page_id || '+b.' || CASE page_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'json' ELSE 'none9' END AS path", "SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN 'dir a/' || page_id || '+b.' || CASE page_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'json' ELSE 'none9' END END AS path"))
def raw_paths(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id")
    plain = F.concat(F.lit("dir%20a/"), "page_id", F.lit("+b."), F.element_at(F.array(*map(F.lit, ("html", "json", "none9"))), (F.col("page_id") % 3 + 1).cast("int")))
    got = text.decoded_path(F.when(F.col("page_id") % 5 == 0, F.concat(plain, F.lit("%f"))).otherwise(plain))
    remote = text.remote_url(F.lit("https://h:1/api/v1?x=y"), F.lit("ns"), F.concat(F.lit("r"), "page_id"))
    return p.select("page_id", got["path"].alias("path"), got["fault"].alias("fault"), text.media_type(plain).alias("media"), remote.alias("remote"))


@query("""WITH h AS (SELECT c_custkey AS id, c_custkey % 256 AS a, (c_custkey * 7) % 256 AS b FROM customer)
SELECT id, coalesce(a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168), false) AS inner4, a >= 252 AND a <= 253 AS inner6 FROM h""")
def sensitive_hosts(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 256).alias("a"), (F.col("c_custkey") * 7 % 256).alias("b"))
    six = F.concat(F.lit("["), F.lower(F.lpad(F.hex("a"), 2, "0")), F.lit("07::5]"))
    return c.select("id", text.sensitive_host(F.concat_ws(".", "a", "b", F.lit("3"), F.lit("4"))).alias("inner4"), text.sensitive_host(six).alias("inner6"))


@query("SELECT event_id, floor(event_id * 1.0)::BIGINT AS seconds, round(event_id / 7.0, 2)::DOUBLE AS share, 'repo_' || sha1('u' || event_id) AS repository, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'e' || event_id END AS label, CASE WHEN event_id % 3 = 2 THEN 'too-long' END AS fault FROM events")
def plain_rules(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id")
    k = F.col("event_id") % 3
    label = text.optional_text(F.when(k == 0, "  ").when(k == 1, F.concat(F.lit(" e"), "event_id", F.lit("\t"))).otherwise(F.lit("x" * 40)), 30)
    share = text.two_decimals((F.col("event_id") / F.lit(7.0)).cast("double"))
    return e.select("event_id", text.unix_floor(F.col("event_id") * 1000 + 999).alias("seconds"), share.alias("share"), text.repository_id(F.sha1(F.concat(F.lit("u"), "event_id"))).alias("repository"), label["value"].alias("label"), label["fault"].alias("fault"))


@query(f"""WITH h AS (SELECT DISTINCT conv_id // 10 AS repo_id, 'refs/heads/conv-' || (conv_id // 10 * 10 + 2) AS target FROM conversations),
p AS (SELECT r.repo_id, r.name, r.oid, r.name AS k FROM fx_refs r UNION ALL SELECT r.repo_id, r.name || '^{{}}', l.target, r.name || chr(0) FROM fx_refs r JOIN fx_links l ON l.repo_id = r.repo_id AND l.source = r.oid WHERE r.oid LIKE 'g:%'
  UNION ALL SELECT h.repo_id, 'HEAD', r.oid, '' FROM h JOIN fx_refs r ON r.repo_id = h.repo_id AND r.name = h.target),
n AS (SELECT p.*, row_number() OVER (PARTITION BY repo_id ORDER BY k) AS nth, target FROM p JOIN h USING (repo_id)),
t AS (SELECT repo_id, 3 AS part, k AS name, oid || ' ' || name || CASE WHEN nth = 1 THEN chr(0) || 'multi_ack_detailed thin-pack side-band-64k ofs-delta object-format=sha1 agent=test/1 symref=HEAD:' || target ELSE '' END || chr(10) AS text FROM n
  UNION ALL SELECT repo_id, 0, '', '# service=git-upload-pack' || chr(10) FROM h)
SELECT repo_id, part, hex(encode(name)) AS name, {hex_line('text')} AS line FROM t UNION ALL SELECT repo_id, k, '', lower(hex(encode('0000'))) FROM h, (VALUES (1), (5)) AS v(k)""")
def advertisement(spark, d):
    o, links, r = parts(spark, d)
    at = spark.read.parquet(f"{d}/conversations.parquet").selectExpr("conv_id DIV 10 AS repo_id", "'symbolic' AS kind", "'refs/heads/conv-' || (conv_id DIV 10 * 10 + 2) AS target").distinct()
    return wire.advertisement(graph.peel(r, links, o), at, "test/1").select("repo_id", "part", F.hex("name").alias("name"), F.lower(F.hex("line")).alias("line"))


@query(f"""WITH r AS (SELECT repo_id, list_sort(list(sha1(oid))) AS oids FROM fx_refs GROUP BY repo_id)
SELECT repo_id AS id, array_to_string(list_transform(oids, lambda o: 'want ' || o), ',') || ',done' AS arguments FROM r""")
def requests_v2(spark, d):
    r = parts(spark, d)[2].groupBy("repo_id").agg(F.array_sort(F.collect_list(F.sha1("oid"))).alias("oids"))
    line = lambda c: codec.pkt_line(F.concat(c, F.lit("\n")))
    mark = lambda c: F.lit(c).cast("binary")
    lines = F.concat(F.array(line(F.lit("command=fetch")), mark("0001")), F.transform("oids", lambda o: line(F.concat(F.lit("want "), o))), F.array(line(F.lit("done")), mark("0000")))
    bodies = r.select(F.col("repo_id").alias("id"), F.aggregate(lines, F.lit("").cast("binary"), lambda a, x: F.concat(a, x)).alias("body"))
    return wire.commands_v2(wire.frames(bodies)).where("fault IS NULL").select("id", F.array_join("arguments", ",").alias("arguments"))


@query(f"{over('st')}, k AS (SELECT repo_id, oid, type, size, row_number() OVER (PARTITION BY repo_id ORDER BY oid) AS nth FROM st WHERE complete AND oid > '2') SELECT repo_id, oid, type, size FROM k WHERE nth <= 8")
def repack_batch(spark, d):
    """The next objects to repack: walked, complete, behind the cursor, in order."""
    objects = table(spark, d, STORE)
    walked = stored(spark, d).select("repo_id", "oid")
    cursors = objects.select("repo_id").distinct().withColumn("cursor", F.lit("2"))
    return maintenance.next_batch(walked.join(objects.where("complete"), ["repo_id", "oid"]), cursors, maintenance.REPACK_BATCH).select("repo_id", "oid", "type", "size")


@query(f"{over('st')} SELECT repo_id, count(DISTINCT oid) AS copied, count(*) AS entries FROM (SELECT repo_id, oid FROM st UNION ALL SELECT repo_id, oid FROM st WHERE type = 'tag') GROUP BY repo_id")
def object_counts(spark, d):
    """A fork counts distinct ids, an import counts the entries of its pack."""
    o = stored(spark, d).select("repo_id", "oid", "type")
    rows = o.unionByName(o.where("type = 'tag'"))
    return rows.groupBy("repo_id").agg(F.count_distinct("oid").alias("copied"), F.count("*").alias("entries"))


@query()
def pack_checksums(spark, d):
    """CRC-32 of every object's deflated form, as pack indexes have it; DuckDB has no such function, so tests compare it with zlib."""
    return stored(spark, d).select("repo_id", "oid", F.crc32(codec.deflated("bytes")).alias("crc"))
