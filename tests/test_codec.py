import hashlib
import random
import time
import zlib

import pytest

from hashgrove.functions import codec, objects
from hashgrove.operators import packs

IDENTITY = b"A <a@example.com> 1700000000 +0000"


def test_known_object_ids():
    assert codec.object_id("blob", b"hello\n") == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert codec.object_id("tree", b"") == "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


def test_delta_round_trip_and_faults():
    r = random.Random(3)
    for _ in range(200):
        base = r.randbytes(r.choice((0, 1, 5, 300, 70_000)))
        cut = r.randint(0, len(base))
        target = base[:cut] + r.randbytes(r.randint(0, 300)) + base[r.randint(cut, len(base)) :]
        assert codec.apply_delta(base, codec.build_delta(base, target)) == target
    with pytest.raises(ValueError):
        codec.apply_delta(b"abc", codec.varint(3) + codec.varint(1) + b"\0")
    with pytest.raises(ValueError):
        codec.apply_delta(b"abc", codec.varint(4) + codec.varint(0))
    assert codec.apply_delta(b"x" * 65_536, codec.varint(65_536) + codec.varint(65_536) + b"\x80") == b"x" * 65_536


def test_tree_and_commit():
    raw = b"100644 a\0" + bytes(range(20)) + b"40000 d\0" + bytes(20)
    assert [(m, n) for m, n, _ in codec.tree_entries(raw)] == [("100644", "a"), ("40000", "d")]
    with pytest.raises(ValueError):
        list(codec.tree_entries(b"9 a\0" + bytes(20)))
    for bad in (b"100644", b"100644 a\0" + bytes(19), b" a\0" + bytes(20)):
        with pytest.raises(ValueError):
            list(codec.tree_entries(bad))


def test_commit_faults(spark):
    t, p = "a" * 40, "b" * 40
    who = IDENTITY.decode()
    head = lambda *lines: "\n".join(lines) + "\n\nhello\n\n"
    cases = {
        "fine": (head(f"tree {t}", f"parent {p}", f"parent {t}", f"author {who}", f"committer B C <> -5", "gpgsig x", " y"), None),
        "a": ("tree x", "no-separator"), "b": (head("tree"), "malformed-header"), "c": (head("tree x"), "tree"), "d": (head(f"tree {t}", "parent x"), "parent"),
        "e": (head(f"tree {t}", f"author {who}"), "identity-missing"), "f": (head(f"tree {t}", "author x", f"committer {who}"), "author"),
        "g": (head(f"tree {t}", f"author {who}", "committer A <b> 9007199254740992"), "committer-timestamp"), "h": (head(f"tree {t}", "author A <b> 99999999999999999999", f"committer {who}"), "author-timestamp"),
    }
    rows = spark.createDataFrame([(1, k, bytearray(v.encode())) for k, (v, _) in cases.items()] + [(1, "n", None)], "repo_id long, oid string, bytes binary")
    got = {r.oid: r for r in objects.commit_fields(rows).collect()}
    assert {k: r.fault for k, r in got.items()} == {k: f for k, (_, f) in cases.items()} | {"n": "no-separator"}
    fine = got["fine"]
    assert (fine.tree, fine.parents, fine.message, fine.author, fine.author_email, fine.authored_at, fine.committer, fine.committer_email, fine.committed_at) == (t, [p, t], "hello\n", "A", "a@example.com", 1700000000, "B C", "", -5)


def test_links_of_objects(spark):
    a, b, c = "a" * 40, "b" * 40, "c" * 40
    tree = b"".join(m + b" n\0" + bytes.fromhex(o) for m, o in ((b"100644", a), (b"40000", b), (b"160000", c), (b"120000", a)))
    rows = [("t1", "tree", tree), ("t2", "tree", tree[:-1]), ("c1", "commit", f"tree {a} \nparent {b}\nparent {b}\nx".encode()), ("c2", "commit", b""), ("c3", "commit", f"tree {a}\nparent z".encode()),
            ("g1", "tag", f"object {c}\ntype tree\n\nobject x".encode()), ("g2", "tag", f"object {c}\n\ntype tree".encode()), ("g3", "tag", b"type tree"), ("b1", "blob", b"tree")]
    got = objects.object_links(spark.createDataFrame([(1, o, t, bytearray(x)) for o, t, x in rows], "repo_id long, oid string, type string, bytes binary")).collect()
    assert sorted((r.source, r.pos, r.target, r.target_type, r.fault) for r in got if not r.fault) == [("c1", 0, a, "tree", None), ("c1", 1, b, "commit", None), ("g1", 0, c, "tree", None), ("t1", 0, a, "blob", None), ("t1", 1, b, "tree", None)]
    assert sorted((r.source, r.pos, r.fault) for r in got if r.fault) == [("c2", -1, "tree"), ("c3", -1, "parent"), ("g2", -1, "type"), ("g3", -1, "object"), ("t2", -1, "malformed")]


def pack_of(*entries):
    body = codec.pack_head(len(entries)) + b"".join(entries)
    return body + hashlib.sha1(body).digest()


def ofs(back, delta):
    out = bytearray([back & 127])
    while back := back >> 7:
        back -= 1
        out.insert(0, back & 127 | 128)
    return codec.entry_head(codec.OFS_DELTA, len(delta)) + bytes(out) + zlib.compress(delta)


def test_packs(spark):
    r = random.Random(5)
    blobs = [r.randbytes(r.randint(0, 40_000)) for _ in range(30)]
    base, middle, target = b"line\n" * 500, b"line\n" * 400 + b"more\n", b"line\n" * 400 + b"most\n"
    ids = {x: codec.object_id("blob", x) for x in (base, middle, target, *blobs)}
    whole = [codec.pack_entry("blob", x) for x in blobs]
    first = codec.pack_entry("blob", base)
    second = ofs(len(first), codec.build_delta(base, middle))
    packs_ = {
        "whole": (pack_of(*whole, codec.pack_entry("tree", b"")), [ids[x] for x in blobs] + [codec.object_id("tree", b"")]),
        "chain": (pack_of(first, second, codec.pack_entry("blob", codec.build_delta(middle, target), ids[middle])), [ids[base], ids[middle], ids[target]]),
        "later": (pack_of(codec.pack_entry("blob", codec.build_delta(base, middle), ids[base]), first), [ids[middle], ids[base]]),
        "thin": (pack_of(codec.pack_entry("blob", codec.build_delta(base, middle), codec.object_id("blob", b"held"))), "corrupt"),
        "gone": (pack_of(codec.pack_entry("blob", codec.build_delta(base, middle), "0" * 40), first), "missing-base"),
        "sum": (pack_of(first)[:-1] + b"x", "checksum-mismatch"), "more": (pack_of(first)[:-20] + b"x" + pack_of(first)[-20:], "trailing-bytes"), "cut": (pack_of(first)[:-40], "truncated"), "none": (b"no pack at all, but long enough", "not-a-pack"),
        "old": (b"PACK" + (4).to_bytes(4, "big") + pack_of()[8:], "unsupported-version"), "big": (pack_of(codec.entry_head(3, codec.LARGEST + 1)), "object-too-large"),
        "kind": (pack_of(codec.entry_head(5, 1) + zlib.compress(b"a")), "corrupt"), "size": (pack_of(codec.entry_head(3, 3) + zlib.compress(b"ab")), "corrupt"), "long": (pack_of(codec.entry_head(3, 1) + zlib.compress(b"ab")), "corrupt"), "null": (None, "truncated"), "empty": (pack_of(), []),
    }
    df = spark.createDataFrame([(k, v and bytearray(v)) for k, (v, _) in packs_.items()], "path string, content binary")
    held = spark.createDataFrame([(codec.object_id("blob", b"held"), "blob", bytearray(b"held"))], "oid string, type string, bytes binary")
    got = packs.unpacked(df, held).collect()
    for k, (_, want) in packs_.items():
        own = sorted((x for x in got if x.path == k), key=lambda x: x.pos)
        assert ([x.fault for x in own] == [want]) if isinstance(want, str) else ([x.oid for x in own] == want), k


def test_pack_reading_is_linear():
    def seconds(n):
        pack, began = pack_of(*[codec.pack_entry("blob", b"x%d" % i) for i in range(n)]), time.process_time()
        assert sum(1 for _ in codec.read_entries(pack)) == n
        return time.process_time() - began

    seconds(500)
    assert seconds(16_000) < 40 * max(seconds(1_000), 0.005)


def test_long_copies_and_memory():
    base = bytes(200_000)
    assert len(codec.build_delta(base, base)) == 3 + 3 + 4
    assert packs.needed_memory(1_000, 1_000) == 4_096


def test_bands(spark):
    raw = random.Random(1).randbytes(150_000)
    df = spark.createDataFrame([(1, 0, "blob", bytearray(raw), None), (1, 1, "blob", bytearray(b"z"), None)], "repo_id long, place int, type string, bytes binary, base string")
    frames = [bytes(x.frame) for x in packs.pack_stream(df, band=True).orderBy("part").collect()]
    assert frames[-1] == b"0000" and all(len(f) <= 65_520 and f[4] == 1 and int(f[:4], 16) == len(f) for f in frames[:-1])
    assert [x[-1] for x in codec.read_entries(b"".join(f[5:] for f in frames[:-1]))] == [raw, b"z"]
