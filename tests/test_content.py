import gzip
import heapq
import random
import zlib

from pyspark.sql import functions as F

from hashgrove.functions import codec, wire
from hashgrove.operators import history, packs


def walked(commits, tip, limit, offset, shallow):
    heap, seen, out, n = [(-commits[tip][1], 0, tip)], {tip}, [], 1
    while heap and len(out) < limit + offset:
        oid = heapq.heappop(heap)[2]
        out.append(oid)
        for p in () if oid in shallow else commits[oid][0]:
            if p not in seen:
                seen.add(p)
                heapq.heappush(heap, (-commits[p][1], n, p))
                n += 1
    return out[offset:]


def test_history_with_skewed_clocks_and_ties(spark):
    r, rows, tips, shallow, want = random.Random(1), [], [], [], []
    for repo in range(30):
        commits = {f"{i:03d}": ([f"{p:03d}" for p in r.sample(range(i), min(i, r.choice((1, 1, 1, 2, 3))))], r.randint(0, 25)) for i in range(60)}
        cut = {f"{r.randrange(60):03d}" for _ in range(3)}
        limit, offset = 7, 4
        want += [(repo, i, o) for i, o in enumerate(walked(commits, "050", limit, offset, cut))]
        rows += [(repo, o, p, d) for o, (p, d) in commits.items()]
        tips.append((repo, "050"))
        shallow += [(repo, o) for o in cut]
    rows += [(99, "a", ["gone"], 5), (98, "a", None, 1)]
    tips += [(99, "a"), (98, "a"), (97, "none")]
    got = history.history(spark.createDataFrame(rows, "repo_id long, oid string, parents array<string>, committed_at long").repartition(7), spark.createDataFrame(tips, "repo_id long, oid string"), 7, 4, spark.createDataFrame(shallow, "repo_id long, oid string")).collect()
    assert sorted((x.repo_id, x.seq, x.oid) for x in got if not x.fault) == sorted(want)
    assert sorted((x.repo_id, x.oid) for x in got if x.fault) == [(97, "none"), (99, "gone")]


def ordered(oids, base):
    inside = {o: b for o, b in base.items() if b in set(oids) and b != o}
    ready = [o for o in oids if o not in inside]
    for o in ready:
        ready += [x for x in oids if inside.get(x) == o]
    return ready + [o for o in oids if o not in set(ready)]


def test_pack_order_and_windows(spark):
    r, rows, deltas, want = random.Random(2), [], [], []
    for repo in range(8):
        oids = [f"o{i}" for i in range(25)]
        r.shuffle(oids)
        base = {o: r.choice(oids) for o in r.sample(oids, 15)}
        base["o1"], base["o2"] = "o2", "o1"
        rows += [(repo, o, i) for i, o in enumerate(oids)]
        deltas += [(repo, o, b) for o, b in base.items()] + [(repo, "o3x", "outside")]
        want += [(repo, i, o) for i, o in enumerate(ordered(oids, base))]
    order = packs.pack_order(spark.createDataFrame(rows, "repo_id long, oid string, pos long"), spark.createDataFrame(deltas, "repo_id long, oid string, base string"))
    got = sorted((x.repo_id, x.place, x.oid) for x in order.collect())
    assert got == sorted(want)
    stored = spark.createDataFrame([(k, o, (n * 7) % 31 + 1, 1, None, None) for k, o, n in rows if n % 5], "repo_id long, oid string, full_size long, full_keys long, delta_size long, delta_keys long")
    size = {(x.repo_id, x.oid): x.full_size for x in stored.collect()}
    windows = {(x.repo_id, x.place): x.window for x in packs.read_windows(order, stored, max_bytes=40, max_keys=4).collect()}
    for repo in range(8):
        w = total = n = 0
        for k, place, oid in (x for x in got if x[0] == repo):
            s = size.get((k, oid))
            if s is not None:
                if n and (total + s > 40 or n + 1 > 4):
                    w, total, n = w + 1, 0, 0
                total, n = total + s, n + 1
            assert windows[k, place] == w


def test_selected_deltas_equal_a_plain_loop(spark):
    r, rows = random.Random(3), []
    for i in range(40):
        body = bytes(random.Random(i // 8).randbytes(700)) + r.randbytes(r.randint(0, 60))
        rows.append((i % 2, codec.object_id("blob", body), "blob", bytearray(body), "x" if i % 9 == 0 else None))
    want, last = [], {}
    for repo, oid, _, body, base in sorted(rows, key=lambda x: x[:2]):
        if base:
            continue
        key, body = (repo, len(body).bit_length()), bytes(body)
        if key in last:
            delta = codec.build_delta(last[key][1], body)
            if len(zlib.compress(delta)) + 20 < 0.875 * len(zlib.compress(body)):
                want.append((repo, oid, last[key][0]))
                continue
        last[key] = (oid, body)
    got = packs.select_deltas(spark.createDataFrame(rows, "repo_id long, oid string, type string, bytes binary, base string")).collect()
    assert want and sorted((x.repo_id, x.oid, x.base) for x in got) == sorted(want)


def test_revisions_and_tag_cycles(spark):
    a = "a" * 40
    table = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    refs = table([(1, "refs/heads/x", "c1"), (1, "refs/tags/x", "t1"), (1, "refs/tags/y", "t1"), (1, "refs/tags/z", "r1"), (1, "refs/heads/b", "b1"), (1, "refs/heads/" + a, "c1")], "repo_id long, name string, oid string")
    objects = table([(1, "c1", "commit"), (1, "t1", "tag"), (1, "t2", "tag"), (1, "r1", "tag"), (1, "r2", "tag"), (1, "b1", "blob"), (1, a, "commit")], "repo_id long, oid string, type string")
    links = table([(1, "t1", "t2"), (1, "t2", "c1"), (1, "r1", "r2"), (1, "r2", "r1")], "repo_id long, source string, target string")
    asked = table([(1, i, v) for i, v in enumerate(("x", "y", "z", "b", "none", a, None))] + [(2, 9, None), (3, 10, None)], "repo_id long, request long, revision string")
    heads = table([(1, "detached", "t2"), (2, "symbolic", "refs/heads/main")], "repo_id long, kind string, target string")
    got = {x.request: (x.commit, x.fault) for x in history.resolve_revision(asked, refs, heads, objects, links).collect()}
    assert got == {0: ("c1", None), 1: ("c1", None), 2: (None, "corrupt"), 3: (None, "wrong-object-type"), 4: (None, "revision-not-found"), 5: (a, None), 6: ("c1", None), 9: (None, None), 10: (None, "revision-not-found")}


def framed(*lines):
    return b"".join(x if x == b"0000" else f"{len(x) + 4:04x}".encode() + x for x in lines)


def test_requests_as_rows(spark):
    o, p = "1" * 40, "2" * 40
    bodies = [(1, framed(f"want {o} ofs-delta thin-pack\n".encode(), f"want {p}\n".encode(), f"shallow {o}\n".encode(), b"deepen 3\n", b"0000", f"have {p}\n".encode(), b"done\n", b"junk")),
              (2, framed(f"shallow {o}\n".encode(), f"want {p}\n".encode(), b"0000")), (3, b"00zz"), (4, b""), (5, None)]
    frames = wire.frames(spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in bodies], "id long, body binary"))
    got = [(x.id, x.verb, x.value, x.capabilities, x.fault) for x in wire.fetch_lines(frames).orderBy("id", "pos").collect()]
    assert got == [(1, "want", o, ["ofs-delta", "thin-pack"], None), (1, "want", p, [], None), (1, "shallow", o, None, None), (1, "deepen", "3", None, None), (1, "have", p, None, None), (1, "done", None, None, None), (2, "shallow", o, None, None), (2, "want", p, [], "malformed")]
    assert [(x.id, x.kind) for x in frames.where("id > 2").collect()] == [(3, "malformed")]
    cut = spark.createDataFrame([(1, bytearray(framed(f"{o} {p} refs/heads/a\0 atomic\n".encode())))], "id long, body binary")
    assert [(x.name, x.capabilities, x.fault) for x in wire.push_commands(wire.frames(cut)).collect()] == [("refs/heads/a", ["atomic"], "truncated")]


def test_banded_report_cursors_and_gzip(spark):
    c = spark.createDataFrame([(1, 1, 0, "refs/heads/a", None, "ok"), (1, 1, 1, "refs/heads/b", "stale\n", "ok")], "repo_id long, push_id long, pos long, name string, reason string, unpack string")
    body = b"".join(bytes(x.line) for x in wire.push_report(c, side_band=True).orderBy("part").collect())
    inner = [framed(b"unpack ok\n"), framed(b"ok refs/heads/a\n"), framed(b"ng refs/heads/b stale\n"), b"0000"]
    assert body == framed(*(b"\x01" + x for x in inner), b"0000")
    odd = spark.createDataFrame([(x,) for x in ("%%%", "", "bm90IGpzb24", "e30", None)], "c string")
    assert all(x.k is None for x in odd.select(wire.decode_cursor(F.col("c"), "a string, b string").alias("k")).collect())
    raw = gzip.compress(b"hello")
    zipped = spark.createDataFrame([(bytearray(x),) for x in (raw, raw + raw, raw[:-1], b"no")] + [(None,)], "b binary")
    assert [x.o and bytes(x.o) for x in zipped.select(wire.gunzipped("b").alias("o")).collect()] == [b"hello", None, None, None, None]
