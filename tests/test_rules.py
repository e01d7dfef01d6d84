"""Rules over request texts, version-2 requests, advertisements, and that no registered query is empty."""

import pytest
from pyspark.sql import functions as F

from hashgrove.functions import text, wire


def table(spark, rows, ddl="t string"):
    return spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], ddl)


def test_sensitive_hosts(spark):
    inner = ["localhost", "a.LOCALHOST", "127.0.0.1", "10.1.2.3", "0.0.0.0", "169.254.1.1", "172.16.0.1", "172.31.255.255", "192.168.0.1", "[::1]", "::", "fc00::1", "fdff::1", "fe80::1", "febf::1", "::ffff:10.0.0.1".replace("10.0.0.1", "a00:1"), "0:0:0:0:0:ffff:7f00:1"]
    outer = ["example.org", "8.8.8.8", "172.32.0.1", "169.253.0.1", "256.1.1.1", "1.2.3", "2001:db8::1", "fec0::1", "::ffff:808:808", "1::2::3", "g::1", "localhost.org", "1:2:3:4:5:6:7"]
    got = {r.t: r.s for r in table(spark, inner + outer).select("t", text.sensitive_host(F.col("t")).alias("s")).collect()}
    assert [h for h in inner if not got[h]] == [] and [h for h in outer if got[h]] == []


def test_texts_and_paths(spark):
    got = table(spark, ["   a b　", "  ", "", None, "x" * 11, "😀" * 5, "😀" * 6]).select(text.optional_text(F.col("t"), 10).alias("o")).collect()
    assert [tuple(r.o) for r in got] == [("a b", None), (None, None), (None, None), (None, None), (None, "too-long"), ("😀" * 5, None), (None, "too-long")]
    got = table(spark, ["a%20b/c+d", "%2525", "%zz", "a%", "%ff", "%C3%A4", ""]).select(text.decoded_path(F.col("t")).alias("o")).collect()
    assert [tuple(r.o) for r in got] == [("a b/c+d", None), ("%25", None), (None, "malformed"), (None, "malformed"), (None, "malformed"), ("ä", None), ("", None)]
    got = table(spark, ["a/b.html", "x.JSON", "noext", "a.b/c", "y.zzz9"]).select(text.media_type(F.col("t")).alias("o")).collect()
    assert [r.o for r in got] == ["text/html", "application/json", *["application/octet-stream"] * 3]


def test_sources_and_remotes(spark):
    got = table(spark, ["https://Host.org/a/b.git?x=1#y", "https://h/a/b/", "http://h:80/a.git", "http://h:8080/a", "not a url"]).select(text.import_source(F.col("t")).alias("o")).collect()
    assert [r.o for r in got] == ["git:https://host.org/a/b.git", "git:https://h/a/b.git", "git:http://h/a.git", "git:http://h:8080/a.git", None]
    got = table(spark, ["https://host:8443/x/y?z"]).select(text.remote_url(F.col("t"), F.lit("n"), F.lit("r")).alias("o"), text.repository_id(F.lit("12-ab")).alias("i")).first()
    assert tuple(got) == ("https://host:8443/git/n/r.git", "repo_12ab")


def test_numbers_and_times(spark):
    got = table(spark, [(1999, 2.345)], "ms long, x double").select(text.unix_floor(F.col("ms")).alias("s"), text.two_decimals(F.col("x")).alias("x"), text.iso_time(F.timestamp_millis("ms")).alias("t")).first()
    assert (got.s, got.x, got.t) == (1, 2.35, "1970-01-01T00:00:01.999Z")


def test_strict_json(spark):
    rows = ['{"a": "x", "b": true, "n": 2}', '{"a": 1}', '{"b": "true"}', '{"a": null}', "[1]", "{", None, "{}"]
    got = table(spark, rows).select(text.strict_json(F.col("t"), {"a": "string", "b": "boolean", "n": "number"}).alias("o")).collect()
    assert [r.o.fault for r in got] == [None, "type", "type", None, "malformed", "malformed", "malformed", None]
    assert tuple(got[0].o.value) == ("x", True, 2.0)
    bad = table(spark, [(10001, "no")], "code int, message string").select(text.envelope(error=F.struct("code", "message")).alias("o")).first().o
    assert bad == '{"errors":[{"code":10001,"message":"no"}],"messages":[],"result":null,"success":false}'


def framed(*lines):
    return b"".join(x if len(x) == 4 and x.startswith(b"000") else f"{len(x) + 4:04x}".encode() + x for x in lines)


def test_version_2_requests(spark):
    o, p = b"1" * 40, b"2" * 40
    bodies = [framed(b"command=fetch\n", b"agent=x", b"0001", b"thin-pack\n", b"want " + o, b"have " + p, b"deepen 2", b"want " + p, b"done", b"0000"), framed(b"command=ls-refs", b"0001", b"peel", b"ref-prefix refs/heads/\n", b"0000"),
              framed(b"command=ls-refs", b"0000"), framed(b"agent=x", b"0001", b"0000"), framed(b"strange=1", b"0001", b"0000"), framed(b"command=fetch", b"0001", b"want " + o), framed(b"command=fetch", b"0001", b"filter blob", b"0000"), framed(b"command=fetch", b"0001", b"deepen 1", b"deepen 2", b"0000"), framed(b"command=other", b"0001", b"anything", b"0000")]
    rows = wire.commands_v2(wire.frames(table(spark, [(i, bytearray(b)) for i, b in enumerate(bodies)], "id long, body binary")))
    got = {r.id: r for r in rows.collect()}
    assert [got[i].fault for i in range(9)] == [None, None, "no-delimiter", "no-command", "capability", "ended-early", "argument", "argument", None]
    assert got[1].command == "ls-refs" and got[1].arguments == ["peel", "ref-prefix refs/heads/"]
    bodies = {r.id: bytes(r.body) for r in wire.fetch_as_v1(rows).collect()}
    assert bodies == {0: framed(b"want " + o + b" multi_ack_detailed side-band-64k thin-pack\n", b"want " + p + b"\n", b"deepen 2\n", b"0000", b"have " + p + b"\n", b"done\n")}
    lines = wire.fetch_lines(wire.frames(table(spark, [(0, bytearray(bodies[0]))], "id long, body binary"))).collect()
    assert [r.verb for r in sorted(lines, key=lambda r: r.pos)] == ["want", "want", "deepen", "have", "done"] and not any(r.fault for r in lines)


def test_push_options(spark):
    o, p = "1" * 40, "2" * 40
    bodies = [framed(f"{o} {p} refs/heads/a\0 push-options\n".encode(), b"0000", b"ci.skip\n", b"x=y", b"0000", b"PACK"), framed(f"{o} {p} refs/heads/a\0 atomic\n".encode(), b"0000", b"0000")]
    got = wire.push_options(wire.frames(table(spark, [(i, bytearray(b)) for i, b in enumerate(bodies)], "id long, body binary"))).orderBy("id", "pos").collect()
    assert [(r.id, r.option) for r in got] == [(0, "ci.skip"), (0, "x=y")]


def test_advertisements(spark):
    o, p, q = "1" * 40, "2" * 40, "3" * 40
    refs = table(spark, [(1, "refs/heads/a", o, None), (1, "refs/tags/v1", p, q), (1, "refs/tags/v1.0", o, None)], "repo_id long, name string, oid string, peeled string")
    heads = table(spark, [(1, "symbolic", "refs/heads/a"), (2, "symbolic", "refs/heads/main"), (3, "detached", p)], "repo_id long, kind string, target string")
    shallow = table(spark, [(1, q)], "repo_id long, oid string")

    def bodies(**kw):
        out = {}
        for r in wire.advertisement(refs, heads, "x/1", **kw).orderBy("repo_id", "part", "name").collect():
            out[r.repo_id] = out.get(r.repo_id, b"") + bytes(r.line)
        return out

    line = lambda t: t.encode() + b"\n"
    got = bodies(version=1, shallow=shallow)
    up = "multi_ack_detailed thin-pack side-band-64k ofs-delta"
    assert got[1] == framed(line("# service=git-upload-pack"), b"0000", line("version 1"), line(f"{o} HEAD\0{up} shallow object-format=sha1 agent=x/1 symref=HEAD:refs/heads/a"), line(f"{o} refs/heads/a"), line(f"{p} refs/tags/v1"), line(f"{q} refs/tags/v1^{{}}"), line(f"{o} refs/tags/v1.0"), line(f"shallow {q}"), b"0000")
    assert got[2] == framed(line("# service=git-upload-pack"), b"0000", line("version 1"), line(f"{'0' * 40} capabilities^{{}}\0{up} object-format=sha1 agent=x/1 symref=HEAD:refs/heads/main"), b"0000")
    assert got[3].endswith(framed(line(f"{p} HEAD\0{up} object-format=sha1 agent=x/1"), b"0000"))
    got = bodies(service="receive-pack")
    assert got[1] == framed(line("# service=git-receive-pack"), b"0000", line(f"{o} refs/heads/a\0{wire.RECEIVES} agent=x/1"), line(f"{p} refs/tags/v1"), line(f"{o} refs/tags/v1.0"), b"0000")
    assert bodies(version=2)[2] == framed(line("version 2"), line("agent=x/1"), line("ls-refs=unborn"), line("fetch"), line("object-format=sha1"), b"0000")


@pytest.mark.parametrize("cyclic", [False, True])
def test_peel_and_closure_end(spark, cyclic):
    from hashgrove.operators import graph

    links = [(1, "g1", "tag", "g2", "tag"), (1, "g2", "tag", "g1" if cyclic else "c1", "tag" if cyclic else "commit"), (1, "g3", "tag", "gone", "commit"), (1, "c1", "commit", "c2", "commit"), (1, "c2", "commit", "c1", "commit"), (1, "c2", "commit", "t", "tree")]
    links = table(spark, links, "repo_id long, source string, source_type string, target string, target_type string")
    objects = table(spark, [(1, o, t) for o, t in (("g1", "tag"), ("g2", "tag"), ("g3", "tag"), ("c1", "commit"))], "repo_id long, oid string, type string")
    refs = table(spark, [(1, "a", "g1"), (1, "b", "g3"), (1, "c", "c1"), (1, "d", "none")], "repo_id long, name string, oid string")
    assert {r["name"]: r.peeled for r in graph.peel(refs, links, objects).collect()} == {"a": None if cyclic else "c1", "b": None, "c": None, "d": None}
    got = {r.oid for r in graph.closure(links, table(spark, [(1, "g1")], "repo_id long, oid string")).collect()}
    assert got == {"g1", "g2"} | (set() if cyclic else {"c1", "c2", "t"})


def test_closure_equals_a_plain_walk(spark):
    import random

    from hashgrove.operators import graph

    r = random.Random(9)
    rows, roots, stops, want, bare = [], [], [], set(), set()
    for repo in range(6):
        n = 80
        up = {i: {max(0, i - 1)} | {r.randrange(i) for _ in range(r.choice((0, 0, 1)))} for i in range(1, n)}
        edges = [(f"c{i:02d}", "commit", f"c{p:02d}", "commit") for i, ps in up.items() for p in ps if r.random() < 0.97] + [(f"c{i:02d}", "commit", f"t{i % 9}", "tree") for i in range(n)] + [(f"t{i}", "tree", f"b{i}", "blob") for i in range(9)]
        rows += [(repo, *e) for e in edges]
        tips, stop = r.sample(range(n), 2), {f"c{i:02d}" for i in r.sample(range(n), 3)} | {"t4"}
        roots += [(repo, f"c{i:02d}") for i in tips]
        stops += [(repo, s) for s in stop]
        for out, skip, blobs in ((want, set(), True), (bare, stop, False)):
            todo = [f"c{i:02d}" for i in tips if f"c{i:02d}" not in skip]
            seen = set(todo)
            while todo:
                at = todo.pop()
                for s, _, t, kind in edges:
                    if s == at and t not in seen | skip and (blobs or kind != "blob"):
                        seen.add(t)
                        todo.append(t)
            out |= {(repo, x) for x in seen}
    links = table(spark, rows, "repo_id long, source string, source_type string, target string, target_type string").repartition(5)
    roots, stops = (table(spark, x, "repo_id long, oid string") for x in (roots, stops))
    assert {tuple(x) for x in graph.closure(links, roots).collect()} == want
    assert {tuple(x) for x in graph.closure(links, roots, stop_at=stops, include_blobs=False).collect()} == bare


def test_checksums_equal_zlib(spark, sf):
    import zlib

    from hashgrove.plans.bytes import stored
    from hashgrove.plans.content import QUERIES

    got = {r.oid: r.crc for r in QUERIES["pack_checksums"](spark, sf).collect()}
    assert got == {r.oid: zlib.crc32(zlib.compress(bytes(r.bytes))) for r in stored(spark, sf).collect()}


def test_cursors_belong_to_their_query(spark):
    made = table(spark, [("name", "asc", "x", "v1")], "sort string, direction string, name string, value string").select(wire.encode_cursor("sort", "direction", "name", "value").alias("t"))
    rows = made.unionByName(table(spark, [None, "", "%%"]))
    schema = "sort string, direction string, name string, value string"
    got = [tuple(r.o) for r in rows.select(wire.bound_cursor(F.col("t"), schema, {"sort": "name", "direction": "asc"}).alias("o")).collect()]
    assert [(k and k.value, f) for k, f in got] == [("v1", None), (None, None), (None, None), (None, "bad-cursor")]
    assert made.select(wire.bound_cursor(F.col("t"), schema, {"sort": "created_at"}).alias("o")).first().o.fault == "query-mismatch"


def test_deepened_fetch_and_old_frames(spark):
    from hashgrove.operators import graph

    links = table(spark, [(1, "c3", "commit", "c2", "commit"), (1, "c2", "commit", "c1", "commit"), (1, "c3", "commit", "t3", "tree"), (1, "c2", "commit", "t2", "tree"), (1, "c1", "commit", "t1", "tree")], "repo_id long, source string, source_type string, target string, target_type string")
    one = lambda *oids: table(spark, [(1, o) for o in oids], "repo_id long, oid string")
    lacks = lambda **kw: {r.oid for r in graph.fetch_difference(links, one("c3"), one("c2"), client_shallow=one("c2"), **kw).collect()}
    assert lacks() == {"c3", "t3"} and lacks(deepened=one("c3")) == {"c3", "t3", "c1", "t1"}
    frames = table(spark, [(1, bytearray(b"0001"))], "id long, body binary")
    assert [r.kind for r in wire.frames(frames).collect()] == ["delimiter"] and [r.kind for r in wire.frames(frames, version=1).collect()] == ["malformed"]
