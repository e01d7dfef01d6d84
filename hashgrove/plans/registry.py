"""Registered queries over the content-addressed tables and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashgrove.functions import codec
from hashgrove.functions.names import branch_violation, holds, object_id, repository_violation, size_bucket, slug_violation
from hashgrove.operators import graph, refs, relational
from hashgrove.sources.fixtures import CHUNK, NOW, ZERO, duck, fixture

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = duck(sql)
        return f

    return put


PAGE = "namespace_slug, name, created_at, last_push_at, read_only"


def page_sql(order: str, where: str = "true", limit: int = 50) -> str:
    return f"WITH p AS (SELECT {PAGE}, row_number() OVER (ORDER BY {order}) AS rn FROM fx_repositories WHERE {where}) SELECT {PAGE}, (SELECT count(*) > {limit} FROM p) AS has_next FROM p WHERE rn <= {limit}"


def repositories(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "fx_repositories").select(*PAGE.split(", "))


ASKED = "SELECT n_nationkey AS request, replace(lower(n_name), '_', '-') AS namespace_slug, 'customer-' || right('000000000' || (n_nationkey * 7 + 1), 9) AS name FROM nation"


@query(f"SELECT request, r.* FROM ({ASKED}) a LEFT JOIN fx_repositories r ON r.namespace_slug = a.namespace_slug AND r.name = a.name")
def repo_point_lookup(spark, d):
    """Lookups by the composite key, one for each namespace; a name that is not there gives nulls."""
    asked = spark.sql(ASKED.replace("FROM nation", "FROM {n}"), n=spark.read.parquet(f"{d}/nation.parquet"))
    return relational.point_lookup(asked, fixture(spark, d, "fx_repositories"), ["namespace_slug", "name"])


@query(page_sql("created_at DESC, name DESC"))
def repo_list_created_desc(spark, d):
    return relational.keyset_page(repositories(spark, d), "created_at", "name", 50, descending=True)


@query(page_sql("coalesce(last_push_at, ''), name"))
def repo_list_last_push_asc(spark, d):
    return relational.keyset_page(repositories(spark, d), "last_push_at", "name", 50)


@query(page_sql("name"))
def repo_list_name_asc(spark, d):
    return relational.keyset_page(repositories(spark, d), "name", "name", 50)


@query(page_sql("coalesce(last_push_at, ''), name", "(coalesce(last_push_at, ''), name) > ('', 'customer-000000500')"))
def repo_list_page2_keyset(spark, d):
    return relational.keyset_page(repositories(spark, d), "last_push_at", "name", 50, after=("", "customer-000000500"))


@query("SELECT name FROM fx_repositories WHERE contains(name, '%') OR contains(lower(name), 'r-00000012')")
def repo_search_literal_wildcard(spark, d):
    df = repositories(spark, d)
    return df.where(holds(F.col("name"), "%") | holds(F.col("name"), "R-00000012")).select("name")


@query("SELECT namespace_slug, count(*) AS total FROM fx_repositories WHERE contains(name, '1') GROUP BY namespace_slug")
def repo_search_total(spark, d):
    return repositories(spark, d).where(holds(F.col("name"), "1")).groupBy("namespace_slug").agg(F.count("*").alias("total"))


@query("SELECT DISTINCT namespace_slug AS slug FROM fx_repositories WHERE namespace_slug > 'f' ORDER BY slug LIMIT 10")
def namespace_page(spark, d):
    return fixture(spark, d, "fx_repositories").select(F.col("namespace_slug").alias("slug")).where("slug > 'f'").distinct().orderBy("slug").limit(10)


@query("SELECT namespace_slug, count(*) AS repositories FROM fx_repositories WHERE namespace_slug NOT LIKE 'nation-1%' GROUP BY namespace_slug")
def namespace_cascade_delete_survivors(spark, d):
    df = fixture(spark, d, "fx_repositories")
    _, kept = relational.cascade_delete(df.select("namespace_slug").distinct(), df, "namespace_slug", F.col("namespace_slug").startswith("nation-1"))
    return kept.groupBy("namespace_slug").agg(F.count("*").alias("repositories"))


NEW = "SELECT CASE WHEN c_custkey % 5 = 0 THEN 'nowhere' ELSE replace(lower(n_name), '_', '-') END AS namespace_slug, CASE WHEN c_custkey % 3 = 0 THEN 'new-' || (c_custkey % 50) ELSE replace(lower(c_name), '#', '-') END AS name, c_custkey AS pos FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query(f"""WITH n AS ({NEW}), f AS (SELECT namespace_slug, name, min(pos) AS first FROM n GROUP BY ALL)
SELECT n.*, CASE WHEN namespace_slug NOT IN (SELECT namespace_slug FROM fx_repositories) THEN 'parent-missing' WHEN (namespace_slug, name) IN (SELECT (namespace_slug, name) FROM fx_repositories) OR pos > first THEN 'name-taken' ELSE 'created' END AS outcome FROM n JOIN f USING (namespace_slug, name)""")
def repo_create_outcomes(spark, d):
    have = fixture(spark, d, "fx_repositories")
    new = spark.sql(NEW.replace("FROM customer JOIN nation", "FROM {c} JOIN {n}"), c=spark.read.parquet(f"{d}/customer.parquet"), n=spark.read.parquet(f"{d}/nation.parquet"))
    return relational.insert_outcomes(new, have, have, ["namespace_slug", "name"], "namespace_slug").select("namespace_slug", "name", "pos", "outcome")


STATE_SQL = f"CASE WHEN revoked_at IS NOT NULL THEN 'revoked' WHEN expires_at_unix <= {NOW} THEN 'expired' ELSE 'active' END"


@query(f"SELECT {STATE_SQL} AS state, count(*) AS n FROM fx_tokens GROUP BY 1")
def token_state_counts(spark, d):
    return fixture(spark, d, "fx_tokens").groupBy(relational.token_state(NOW).alias("state")).agg(F.count("*").alias("n"))


@query(f"SELECT id, created_at, {STATE_SQL} AS state FROM fx_tokens ORDER BY created_at DESC, id DESC LIMIT 30 OFFSET 60")
def token_page_offset(spark, d):
    df = fixture(spark, d, "fx_tokens").select("id", "created_at", relational.token_state(NOW).alias("state"))
    return relational.offset_page(df, [F.desc("created_at"), F.desc("id")], 3, 30)


@query(f"SELECT owner, count(*) AS usable FROM fx_tokens WHERE revoked_at IS NULL AND expires_at_unix > {NOW} AND scope = 'write' GROUP BY owner")
def token_authorize(spark, d):
    return relational.authorized(fixture(spark, d, "fx_tokens"), "write", NOW).groupBy("owner").agg(F.count("*").alias("usable"))


NAMES = "SELECT part.p_partkey AS k, CASE part.p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN lower(p_name) WHEN 2 THEN replace(lower(p_name), ' ', '-') WHEN 3 THEN 'api' WHEN 4 THEN repeat('a', 40 + p_size * 5) WHEN 5 THEN 'x.git' WHEN 6 THEN 'a/.b' ELSE replace(p_type, ' ', '/') END AS s FROM part"


@query(f"""WITH n AS ({NAMES}) SELECT k,
CASE WHEN length(s) = 0 THEN 'empty' WHEN length(s) > 39 THEN 'too-long' WHEN NOT regexp_matches(s, '^[a-z0-9]([a-z0-9-]*[a-z0-9])?$') THEN 'malformed' WHEN s IN ('api', 'git', 'healthz', 'static', 'well-known') THEN 'reserved' END AS slug,
CASE WHEN length(s) = 0 THEN 'empty' WHEN length(s) > 100 THEN 'too-long' WHEN NOT regexp_matches(s, '^[a-z0-9]([a-z0-9._-]*[a-z0-9])?$') THEN 'malformed' WHEN s LIKE '%.git' THEN 'git-suffix' END AS repository,
CASE WHEN length(s) = 0 THEN 'empty' WHEN length(s) > 255 THEN 'too-long' WHEN NOT regexp_matches(s, '^[A-Za-z0-9][A-Za-z0-9._/-]*$') OR contains(s, '..') OR s LIKE '%.' OR regexp_matches(s, '(^|/)(/|$|\\.)|\\.lock(/|$)') THEN 'malformed' END AS branch FROM n""")
def validate_names(spark, d):
    n = spark.sql(NAMES.replace("FROM part", "FROM {part} part"), part=spark.read.parquet(f"{d}/part.parquet"))
    s = F.col("s")
    return n.select("k", slug_violation(s).alias("slug"), repository_violation(s).alias("repository"), branch_violation(s).alias("branch"))


OID = "sha1(encode('blob ' || octet_length(encode(text))) || '\\x00'::BLOB || encode(text))"


@query(f"SELECT doc_id, {OID} AS oid, size FROM fx_blobs")
def object_ids(spark, d):
    return fixture(spark, d, "fx_blobs").select("doc_id", object_id(F.lit("blob"), F.col("text")).alias("oid"), "size")


@query(f"SELECT {OID} AS oid, min(doc_id) AS doc_id, count(*) AS copies, any_value(size) AS size FROM fx_blobs GROUP BY 1")
def object_dedup(spark, d):
    df = fixture(spark, d, "fx_blobs").withColumn("oid", object_id(F.lit("blob"), F.col("text")))
    return df.groupBy("oid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("size").alias("size"))


@query(f"SELECT doc_id, idx::INT AS idx, md5(array_slice(encode(text), (idx * {CHUNK} + 1)::BIGINT, ((idx + 1) * {CHUNK})::BIGINT)) AS digest FROM (SELECT *, unnest(range((size + {CHUNK - 1}) // {CHUNK})) AS idx FROM fx_blobs)")
def object_chunks(spark, d):
    from hashgrove.operators.store import pieces

    blobs = fixture(spark, d, "fx_blobs").select(F.lit(0).alias("repo_id"), F.col("doc_id").alias("oid"), F.col("text").cast("binary").alias("bytes"))
    return pieces(blobs).select(F.col("oid").alias("doc_id"), "idx", F.md5("bytes").alias("digest"))


def hex_line(text: str) -> str:
    return f"lower(hex(encode(printf('%04x', 4 + octet_length(encode({text}))) || {text})))"


@query("SELECT 'blob:' || (length(bin(greatest(size, 1))) - 1) AS bucket, count(*) AS n FROM fx_blobs GROUP BY 1")
def size_buckets(spark, d):
    return fixture(spark, d, "fx_blobs").groupBy(size_bucket(F.lit("blob"), F.col("size")).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT o.repo_id, oid, type, size, list_sort(list(target) FILTER (target IS NOT NULL)) AS targets FROM fx_objects o LEFT JOIN fx_links l ON l.repo_id = o.repo_id AND source = oid GROUP BY ALL".replace("list_sort(list(target) FILTER (target IS NOT NULL)) AS targets", "coalesce(array_to_string(list_sort(list(target) FILTER (target IS NOT NULL)), ','), '') AS targets"))
def indexed_frontier(spark, d):
    o = fixture(spark, d, "fx_objects")
    links = fixture(spark, d, "fx_links").select("repo_id", F.col("source").alias("oid"), "target")
    return o.join(links, ["repo_id", "oid"], "left").groupBy("repo_id", "oid", "type", "size").agg(F.array_join(F.sort_array(F.collect_list("target")), ",").alias("targets"))


def walk_sql(roots: str, edges: str = "fx_links", stop: str = "SELECT NULL, NULL WHERE false", name: str = "w") -> str:
    return f"stop_{name}(r, o) AS ({stop}), {name} AS (SELECT repo_id, oid FROM ({roots}) WHERE (repo_id, oid) NOT IN (SELECT (r, o) FROM stop_{name}) UNION SELECT e.repo_id, e.target FROM {name} JOIN {edges} e ON e.repo_id = {name}.repo_id AND e.source = {name}.oid WHERE (e.repo_id, e.target) NOT IN (SELECT (r, o) FROM stop_{name}))"


#: Tips are all branches. A fetch wants some of them and has others, which are its input, not a sample.
TIPS = "SELECT repo_id, oid FROM fx_refs WHERE name LIKE 'refs/heads/%'"
WANTS = "SELECT repo_id, oid FROM fx_refs WHERE name LIKE 'refs/heads/%9'"
HAVES = "SELECT repo_id, oid FROM fx_refs WHERE name LIKE 'refs/heads/%8'"
SHALLOW = "SELECT repo_id, oid FROM fx_objects WHERE oid LIKE 'c:%9:0'"


def parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return fixture(spark, d, "fx_objects"), fixture(spark, d, "fx_links"), fixture(spark, d, "fx_refs")


def tips(r: DataFrame) -> DataFrame:
    return r.where("name LIKE 'refs/heads/%'").select("repo_id", "oid")


def heads(r: DataFrame, last: str) -> DataFrame:
    return r.where(f"name LIKE 'refs/heads/%{last}'").select("repo_id", "oid")


@query("WITH " + walk_sql("SELECT repo_id, oid FROM fx_refs") + " SELECT repo_id, oid FROM w")
def closure_full(spark, d):
    _, links, r = parts(spark, d)
    return graph.closure(links, r).select("repo_id", "oid")


@query("WITH e AS (SELECT * FROM fx_links WHERE target_type <> 'blob'), " + walk_sql(TIPS, "e") + " SELECT repo_id, oid FROM w")
def closure_no_blobs(spark, d):
    _, links, r = parts(spark, d)
    return graph.closure(links, tips(r), include_blobs=False).select("repo_id", "oid")


@query("WITH " + walk_sql(WANTS, stop=HAVES) + " SELECT repo_id, oid FROM w")
def closure_stop(spark, d):
    _, links, r = parts(spark, d)
    return graph.closure(links, heads(r, "9"), stop_at=heads(r, "8")).select("repo_id", "oid")


@query(f"WITH e AS (SELECT * FROM fx_links WHERE NOT (target_type = 'commit' AND source LIKE 'c:%9:0')), {walk_sql(TIPS, 'e')} SELECT repo_id, oid FROM w")
def closure_shallow(spark, d):
    o, links, r = parts(spark, d)
    return graph.closure(links, tips(r), shallow=o.where("oid LIKE 'c:%9:0'").select("repo_id", "oid")).select("repo_id", "oid")


@query("WITH " + walk_sql(TIPS) + " SELECT repo_id, oid FROM w WHERE oid LIKE 'b:%'")
def reachable_candidates(spark, d):
    o, links, r = parts(spark, d)
    found = graph.closure(links, tips(r))
    return o.where("type = 'blob'").join(found, ["repo_id", "oid"], "left_semi").select("repo_id", "oid")


@query("WITH " + walk_sql(WANTS, stop=HAVES) + ", " + walk_sql(HAVES, name="h") + " SELECT repo_id, oid FROM w EXCEPT SELECT repo_id, oid FROM h")
def fetch_difference(spark, d):
    _, links, r = parts(spark, d)
    return graph.fetch_difference(links, heads(r, "9"), heads(r, "8"))


BROKEN = "oid LIKE 't:%:1' AND CAST(split_part(oid, ':', 2) AS INT) % 17 = 0"


@query(f"WITH {walk_sql('SELECT repo_id, oid FROM fx_refs')} SELECT repo_id, oid FROM w WHERE {BROKEN}")
def missing_objects(spark, d):
    o, links, r = parts(spark, d)
    return graph.missing(graph.closure(links, r), o.where(f"NOT ({BROKEN})"))


@query(f"WITH {walk_sql('SELECT repo_id, oid FROM fx_refs')} SELECT repo_id, bool_and(NOT ({BROKEN})) AS complete, count(*) AS n FROM w GROUP BY repo_id")
def closure_complete(spark, d):
    o, links, r = parts(spark, d)
    return graph.complete_closure(graph.closure(links, r), o.where(f"NOT ({BROKEN})"))


@query(f"""WITH e AS (SELECT * FROM fx_links WHERE target_type = 'commit' AND source LIKE 'c:%'),
w AS (SELECT repo_id, oid, 1 AS depth FROM ({TIPS}) UNION SELECT e.repo_id, target, depth + 1 FROM w JOIN e ON e.repo_id = w.repo_id AND e.source = w.oid WHERE depth < 3),
m AS (SELECT repo_id, oid, min(depth)::INT AS depth FROM w GROUP BY ALL)
SELECT *, depth = 3 AND (repo_id, oid) IN (SELECT (repo_id, source) FROM e) AS shallow, false AS unshallow FROM m""")
def depth_plan(spark, d):
    _, links, r = parts(spark, d)
    return graph.depth_plan(links, tips(r), 3)


@query("SELECT r.repo_id, r.name, r.oid, l.target AS peeled FROM fx_refs r LEFT JOIN fx_links l ON l.repo_id = r.repo_id AND l.source = r.oid AND r.oid LIKE 'g:%'")
def ref_peeled(spark, d):
    o, links, r = parts(spark, d)
    return graph.peel(r, links, o)


@query("WITH " + walk_sql("SELECT repo_id, oid FROM fx_refs") + " SELECT o.* FROM fx_objects o WHERE (repo_id, oid) NOT IN (SELECT (repo_id, oid) FROM w)")
def sweep_orphans(spark, d):
    return graph.sweep(*parts(spark, d))


@query("WITH " + walk_sql("SELECT repo_id, oid FROM fx_refs") + " SELECT type, count(*) AS objects, sum(size)::BIGINT AS bytes FROM fx_objects WHERE (repo_id, oid) NOT IN (SELECT (repo_id, oid) FROM w) GROUP BY type")
def sweep_totals(spark, d):
    return graph.sweep(*parts(spark, d)).groupBy("type").agg(F.count("*").alias("objects"), F.sum("size").cast("long").alias("bytes"))


@query("WITH " + walk_sql(TIPS) + " SELECT 1000 AS repo_id, oid, type, size FROM fx_objects WHERE (repo_id, oid) IN (SELECT (repo_id, oid) FROM w)")
def fork_default_branch(spark, d):
    o, links, r = parts(spark, d)
    return graph.fork(o, links, tips(r), 1000).select("repo_id", "oid", "type", "size")


@query("SELECT repo_id, name, pos, CASE WHEN NOT bogus THEN NULL WHEN prev IS NULL THEN 'the ref no longer exists' ELSE 'the ref has moved since it was advertised' END AS reason FROM fx_commands")
def push_replay(spark, d):
    return refs.replay(fixture(spark, d, "fx_commands")).select("repo_id", "name", "pos", "reason")


@query("SELECT repo_id, name, max_by(new_oid, pos) AS oid FROM fx_commands WHERE NOT bogus GROUP BY repo_id, name")
def refs_after_push(spark, d):
    return refs.refs_after(refs.replay(fixture(spark, d, "fx_commands")))



def one_push(spark: SparkSession, d: str) -> DataFrame:
    c = fixture(spark, d, "fx_commands")
    held = c.where("pos % 7 < 4 AND NOT bogus").groupBy("repo_id", "name").agg(F.max_by("new_oid", "pos").alias("oid"))
    return refs.screen(c.withColumn("push_id", F.expr("pos DIV 40")), held)


SCREEN = f"""s AS (SELECT repo_id, name, max_by(new_oid, pos) AS oid FROM fx_commands WHERE pos % 7 < 4 AND NOT bogus GROUP BY ALL),
x AS (SELECT c.repo_id, c.name, c.pos, pos // 40 AS push_id, CASE WHEN row_number() OVER (PARTITION BY c.repo_id, pos // 40, c.name ORDER BY pos) > 1 THEN 'the same ref appears twice in this push'
  WHEN old_oid = '{ZERO}' THEN CASE WHEN oid IS NOT NULL THEN 'the ref already exists' END WHEN oid IS NULL THEN 'the ref no longer exists' WHEN oid <> old_oid THEN 'the ref has moved since it was advertised' END AS reason FROM fx_commands c LEFT JOIN s ON s.repo_id = c.repo_id AND s.name = c.name)"""


@query(f"WITH {SCREEN} SELECT repo_id, name, pos, reason FROM x")
def push_screening(spark, d):
    return one_push(spark, d).select("repo_id", "name", "pos", "reason")


@query(f"WITH {SCREEN} SELECT repo_id, name, pos, CASE WHEN reason IS NULL AND bool_or(reason IS NOT NULL) OVER (PARTITION BY repo_id, push_id) THEN 'atomic push failure' ELSE reason END AS reason FROM x")
def push_atomic(spark, d):
    return refs.atomic(one_push(spark, d)).select("repo_id", "name", "pos", "reason")


@query("SELECT a.conv_id, a.turn, md5(a.text) AS digest FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1")
def delta_roundtrip(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.col("text").cast("binary").alias("target"))
    base = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("target").alias("base"))
    pairs = c.join(base, ["conv_id", "turn"]).withColumn("delta", codec.delta_of("base", "target"))
    return pairs.select("conv_id", "turn", F.md5(codec.patched("base", "delta")).alias("digest"))


@query("SELECT conv_id, turn, encode(printf('%04x', 4 + octet_length(encode(role))) || role) AS line FROM conversations".replace("encode(printf('%04x', 4 + octet_length(encode(role))) || role)", "lower(hex(encode(printf('%04x', 4 + octet_length(encode(role))) || role)))"))
def pkt_lines(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.lower(F.hex(codec.pkt_line(F.col("role")))).alias("line"))
