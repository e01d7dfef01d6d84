"""Content-addressed tables derived from the test tables; one SQL text serves Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ZERO = "0" * 40
CHUNK = 16_384
NOW = 946_684_800

#: name: SQL over the raw tables; @DIV is integer division, @ISO(x) an ISO-8601 text of a timestamp, @DATE(n) 1995-01-01 plus n days,
#: @JOINED(x BY k) the texts x in the order of k. fx_bytes has objects as hexadecimal bytes, some of them malformed.
SQL = {
    "fx_repositories": """SELECT replace(lower(n_name), '_', '-') AS namespace_slug, replace(lower(c_name), '#', '-') AS name, 'repo_' || c_custkey AS id,
        @DATE(c_custkey % 97) AS created_at, @ISO(p.pushed) AS last_push_at, c_acctbal < 0 AS read_only
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS pushed FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY o_custkey) p ON p.o_custkey = c_custkey""",
    "fx_tokens": """SELECT substr(sha1(CAST(o_orderkey AS VARCHAR(20))), 1, 16) AS id, o_custkey AS owner, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'read' ELSE 'write' END AS scope,
        @EPOCH(o_orderdate) + 31536000 AS expires_at_unix, @ISO(o_orderdate) AS created_at, CASE WHEN o_orderstatus = 'F' THEN @ISO(o_orderdate) END AS revoked_at FROM orders""",
    "fx_blobs": "SELECT doc_id, text, octet_length(encode(text, 'UTF-8')) AS size FROM documents",
    "fx_links": """SELECT repo_id, source, CASE substr(source, 1, 1) WHEN 'c' THEN 'commit' WHEN 't' THEN 'tree' ELSE 'tag' END AS source_type, target, target_type FROM (
        SELECT conv_id @DIV 10 AS repo_id, 'c:' || conv_id || ':' || turn AS source, 't:' || conv_id || ':' || turn AS target, 'tree' AS target_type FROM conversations
        UNION ALL SELECT conv_id @DIV 10, 'c:' || conv_id || ':' || turn, 'c:' || conv_id || ':' || (turn - 1), 'commit' FROM conversations WHERE turn > 0
        UNION ALL SELECT a.conv_id @DIV 10, 'c:' || a.conv_id || ':0', 'c:' || b.conv_id || ':' || b.last, 'commit' FROM conversations a JOIN (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) b ON b.conv_id = a.conv_id - 1 WHERE a.turn = 0 AND a.conv_id % 10 IN (3, 6, 9)
        UNION ALL SELECT a.conv_id @DIV 10, 't:' || a.conv_id || ':' || a.turn, 'b:' || a.conv_id || ':' || b.turn, 'blob' FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn <= a.turn
        UNION ALL SELECT conv_id @DIV 10, 'g:' || conv_id, 'c:' || conv_id || ':' || max(turn), 'commit' FROM conversations WHERE conv_id % 5 = 0 GROUP BY conv_id) x""",
    "fx_objects": """SELECT conv_id @DIV 10 AS repo_id, 'c:' || conv_id || ':' || turn AS oid, 'commit' AS type, length(text) AS size FROM conversations
        UNION ALL SELECT conv_id @DIV 10, 't:' || conv_id || ':' || turn, 'tree', 32 * (turn + 1) FROM conversations
        UNION ALL SELECT conv_id @DIV 10, 'b:' || conv_id || ':' || turn, 'blob', length(text) FROM conversations
        UNION ALL SELECT DISTINCT conv_id @DIV 10, 'g:' || conv_id, 'tag', 64 FROM conversations WHERE conv_id % 5 = 0""",
    "fx_refs": """SELECT conv_id @DIV 10 AS repo_id, 'refs/heads/conv-' || conv_id AS name, 'c:' || conv_id || ':' || max(turn) AS oid FROM conversations WHERE conv_id % 10 <> 1 GROUP BY conv_id
        UNION ALL SELECT DISTINCT conv_id @DIV 10, 'refs/tags/v' || conv_id, 'g:' || conv_id FROM conversations WHERE conv_id % 5 = 0""",
    "fx_bytes": """SELECT conv_id @DIV 10 AS repo_id, sha1('c:' || conv_id || ':' || turn) AS oid, 'commit' AS type,
        hex('tree ' || sha1('t:' || conv_id || ':' || turn) || chr(10) || CASE WHEN turn > 0 THEN 'parent ' || sha1('c:' || conv_id || ':' || (turn - 1)) || chr(10) ELSE '' END
          || 'author ' || role || ' <' || role || '@example.org> ' || (conv_id * 100 + turn) || ' +0100' || chr(10) || 'committer ' || role || CASE WHEN conv_id % 13 = 5 AND turn = 1 THEN ' ' ELSE ' <c@example.org> ' END || (conv_id * 100 + turn + 7) || chr(10)
          || CASE WHEN turn % 2 = 1 THEN 'signature a' || chr(10) || ' b' || chr(10) ELSE '' END || chr(10) || 'turn ' || turn || chr(10) || chr(10)) AS raw FROM conversations
        UNION ALL SELECT a.conv_id @DIV 10, sha1('t:' || a.conv_id || ':' || a.turn), 'tree',
        @JOINED(hex(CASE b.turn % 4 WHEN 1 THEN '100755' WHEN 2 THEN '120000' WHEN 3 THEN '160000' ELSE '100644' END || ' f' || b.turn) || '00' || sha1('b:' || b.conv_id || ':' || b.turn) BY b.turn)
          || CASE WHEN a.turn > 0 THEN hex('40000 sub') || '00' || sha1('t:' || a.conv_id || ':' || (a.turn - 1)) ELSE '' END || CASE WHEN a.conv_id % 17 = 3 AND a.turn = 2 THEN '31' ELSE '' END
        FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn <= a.turn GROUP BY a.conv_id, a.turn
        UNION ALL SELECT conv_id @DIV 10, sha1('b:' || conv_id || ':' || turn), 'blob', hex(text) FROM conversations
        UNION ALL SELECT conv_id @DIV 10, sha1('g:' || conv_id), 'tag', hex('object ' || sha1('c:' || conv_id || ':' || max(turn)) || chr(10) || 'type ' || CASE WHEN conv_id % 20 = 15 THEN 'thing' ELSE 'commit' END || chr(10) || 'tag v' || conv_id || chr(10) || chr(10) || 'm' || chr(10)) FROM conversations WHERE conv_id % 5 = 0 GROUP BY conv_id""",
    "fx_commands": f"""SELECT repo_id, name, pos, coalesce(CASE WHEN bogus THEN sha1('x:' || pos) ELSE prev END, '{ZERO}') AS old_oid, new_oid, bogus, prev FROM (
        SELECT *, max_by(fine, pos) OVER (PARTITION BY repo_id, name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (
        SELECT user_id % 50 AS repo_id, 'refs/heads/' || event_type AS name, event_id AS pos, sha1('e:' || event_id) AS new_oid, event_id % 11 = 0 AS bogus,
        CASE WHEN event_id % 11 <> 0 THEN sha1('e:' || event_id) END AS fine FROM events) x) y""",
}
RAW = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text_for(sql: str, duck: bool) -> str:
    iso = r"strftime(\1, '%Y-%m-%dT%H:%M:%S') || '.000Z'" if duck else r"date_format(\1, \"yyyy-MM-dd'T'HH:mm:ss\") || '.000Z'"
    date = r"strftime(DATE '1995-01-01' + CAST(\1 AS INT), '%Y-%m-%d') || 'T00:00:00.000Z'" if duck else r"date_format(date_add(DATE '1995-01-01', CAST(\1 AS INT)), 'yyyy-MM-dd') || 'T00:00:00.000Z'"
    epoch = r"CAST(epoch(\1) AS BIGINT)" if duck else r"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', \1)"
    for mark, to in (("ISO", iso), ("DATE", date), ("EPOCH", epoch)):
        sql = re.sub(rf"@{mark}\(([^()]*)\)", to.replace('\\"', '"'), sql)
    sql = re.sub(r"@JOINED\((.*) BY ([\w.]+)\)", r"string_agg(\1, '' ORDER BY \2)" if duck else r"listagg(\1, '') WITHIN GROUP (ORDER BY \2)", sql)
    sql = sql.replace("@DIV", "//" if duck else "DIV")
    return sql.replace("octet_length(encode(text, 'UTF-8'))", "octet_length(encode(text))") if duck else sql.replace("max_by(fine, pos) OVER", "last(fine, true) OVER")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = text_for(SQL[name], duck=False)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in RAW if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **tables)


def duck(body: str) -> str:
    """body, a SELECT or a list of CTEs and a SELECT, with the fixtures that it names as leading CTEs."""
    used = [n for n in SQL if re.search(rf"\b{n}\b", body)]
    ctes = ", ".join(f"{n} AS ({text_for(SQL[n], duck=True)})" for n in used)
    body = body.strip()
    if not used:
        return body
    return f"WITH RECURSIVE {ctes}, {body[5:]}" if body.startswith("WITH ") else f"WITH RECURSIVE {ctes} {body}"
