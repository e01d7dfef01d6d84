"""Framed requests as rows, reports and listings as framed lines, gzip members and page cursors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from hashgrove.functions.codec import pkt_line

#: Lengths that mark no line, the longest line, the data band, and the bound of a gzip body.
MARKS, LONGEST, DATA_BAND, BODY = {0: "flush", 1: "delimiter", 2: "response-end"}, 65_520, 1, 16 << 20
FLUSH = "0000"
#: Frames, or bytes of them, beyond which a batch is handed on.
FRAME_ROWS, FRAME_BYTES = 20_000, 8 << 20
OID = "[0-9a-f]{40}"


def read_frames(version: int):
    """The function of ``frames`` on batches. Frames of many bodies go in one batch: one batch a body cost more than to read it."""
    def split(raw: bytes) -> Iterator[tuple[str, bytes | None]]:
        at = 0
        while at < len(raw):
            digits = raw[at : at + 4]
            n = int(digits, 16) if len(digits) == 4 and not set(digits.lower()) - set(b"0123456789abcdef") else 3
            if n in MARKS and (n == 0 or version == 2):
                yield MARKS[n], None
            elif n < 4 or n > LONGEST or at + n > len(raw):
                yield "malformed", None
                return
            else:
                yield "line", raw[at + 4 : at + n]
            at += max(n, 4)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string(), pa.binary()))], names=["id", "pos", "kind", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for key, body in zip(batch.column("id").to_pylist(), batch.column("body")):
                if not body.is_valid:
                    continue
                for i, (kind, payload) in enumerate(split(body.as_buffer().to_pybytes())):
                    rows.append((key, i, kind, payload))
                    held += len(payload or b"")
                    if len(rows) >= FRAME_ROWS or held >= FRAME_BYTES:
                        yield packed(rows)
                        rows, held = [], 0
            if rows:
                yield packed(rows)

    return run


def frames(bodies: DataFrame, version: int = 2) -> DataFrame:
    """(id, pos, kind, payload) of the frames of bodies (id, body): kind line, flush, delimiter, response-end, or malformed, which ends a body.
    Delimiter and response-end are malformed before version 2.

    A body is read in one task as it is one request; null and empty bodies have no frames.
    """
    return bodies.select(F.col("id").cast("long"), "body").mapInArrow(read_frames(version), "id long, pos int, kind string, payload binary")


def sections(rows: DataFrame) -> DataFrame:
    """frames with ``section``: how many flushes of the same body stand before."""
    return rows.withColumn("section", F.coalesce(F.sum((F.col("kind") == "flush").cast("int")).over(Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def push_commands(rows: DataFrame) -> DataFrame:
    """(id, pos, old_oid, new_oid, name, capabilities, fault) of the command lines of pushes, those before the first flush.

    Capabilities follow a NUL on a line. A line of another form is ``malformed``; a push that ends before its flush is ``truncated``.
    """
    text = F.regexp_replace(F.col("payload").cast("string"), "\n$", "")
    head, rest = F.split(text, "\u0000")[0], F.get(F.split(text, "\u0000"), F.lit(1))
    part = lambda i: F.nullif(F.regexp_extract(head, f"^({OID}) ({OID}) (.+)$", i), F.lit(""))
    whole = F.max(F.col("kind") == "flush").over(Window.partitionBy("id"))
    lines = sections(rows).withColumn("whole", whole).where("section = 0 AND kind <> 'flush'")
    fault = F.when((F.col("kind") != "line") | part(1).isNull(), "malformed").when(~F.col("whole"), "truncated")
    return lines.select("id", "pos", part(1).alias("old_oid"), part(2).alias("new_oid"), part(3).alias("name"), F.filter(F.split(rest, " "), lambda c: c != "").alias("capabilities"), fault.alias("fault"))


def push_options(rows: DataFrame) -> DataFrame:
    """(id, pos, option) of the lines between the first and the second flush of pushes whose first command asks for push-options."""
    first = push_commands(rows).groupBy("id").agg(F.min_by("capabilities", "pos").alias("capabilities"))
    asked = first.where("array_contains(capabilities, 'push-options')").select("id")
    return sections(rows).where("section = 1 AND kind = 'line'").join(asked, "id", "left_semi").select("id", "pos", F.regexp_replace(F.col("payload").cast("string"), "\n$", "").alias("option"))


def commands_v2(rows: DataFrame) -> DataFrame:
    """(id, command, arguments, fault) of requests of version 2: capability lines, a delimiter, arguments, a flush.

    Faults: no-delimiter, capability (one that is not served), no-command, ended-early, and argument for one that the command,
    ls-refs or fetch, does not know.
    """
    text = F.regexp_replace(F.col("payload").cast("string"), "\n$", "")
    by = Window.partitionBy("id").orderBy("pos")
    marked = rows.select("id", "pos", "kind", text.alias("text")).withColumn("mark", F.min(F.when(F.col("kind") != "line", F.col("pos"))).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    own = marked.groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(F.col("mark").isNull() | (F.col("pos") < F.col("mark")), F.struct("pos", "text")))).alias("head"), F.min(F.when(F.col("pos") == F.col("mark"), F.col("kind"))).alias("ends"),
        F.array_sort(F.collect_list(F.when(F.col("pos") > F.col("mark"), F.struct("pos", "kind", "text")))).alias("tail"))
    command = lambda x: F.startswith(x["text"], F.lit("command="))
    name = F.get(F.filter("head", command), F.lit(0))["text"]
    odd = F.exists("head", lambda x: ~command(x) & ~F.startswith(x["text"], F.lit("agent=")) & (x["text"] != "object-format=sha1")) | (F.size(F.filter("head", command)) > 1)
    stop = F.array_position(F.transform("tail", lambda x: x["kind"]), "flush")
    lines = F.slice("tail", 1, F.greatest(stop.cast("int") - 1, F.lit(0)))
    arguments, called = F.transform(lines, lambda x: x["text"]), F.substr(name, F.lit(9))
    known = {"ls-refs": "^(peel|symrefs|unborn|ref-prefix .*)$", "fetch": "^((want|have|shallow) .*|deepen [1-9][0-9]*|done|thin-pack|ofs-delta|no-progress|include-tag)$"}
    odd_one = lambda form: F.exists(arguments, lambda x: ~x.rlike(form))
    strange = reduce(lambda a, b: a | b, ((called == k) & odd_one(form) for k, form in known.items()))
    twice = (called == "fetch") & (F.size(F.filter(arguments, lambda x: F.startswith(x, F.lit("deepen ")))) > 1)
    fault = (F.when(F.coalesce(F.col("ends"), F.lit("")) != "delimiter", "no-delimiter").when(odd, "capability").when(F.coalesce(called, F.lit("")) == "", "no-command")
             .when((stop == 0) | F.exists(lines, lambda x: x["kind"] != "line"), "ended-early").when(strange | twice, "argument"))
    return own.select("id", called.alias("command"), arguments.alias("arguments"), fault.alias("fault"))


def fetch_as_v1(commands: DataFrame) -> DataFrame:
    """(id, body) of the fetches among commands_v2 rows as requests of the first version: wants with capabilities, shallows, depth, flush, haves, done or flush."""
    args = F.col("arguments")
    of = lambda verb: F.filter(args, lambda x: F.startswith(x, F.lit(verb + " ")))
    line = lambda t: pkt_line(F.concat(t, F.lit("\n")))
    asked = lambda c: F.when(F.array_contains(args, c), F.lit(" " + c)).otherwise("")
    extra = F.concat(F.lit(" multi_ack_detailed side-band-64k"), asked("thin-pack"), asked("ofs-delta"))
    wants = F.transform(of("want"), lambda x, i: line(F.concat(x, F.when(i == 0, extra).otherwise(""))))
    rest = [F.transform(of(v), line) for v in ("shallow", "deepen")]
    flush = F.array(F.lit(FLUSH).cast("binary"))
    ends = F.when(F.array_contains(args, "done"), F.array(line(F.lit("done")))).otherwise(flush)
    parts = F.concat(wants, *rest, flush, F.transform(of("have"), line), ends)
    return commands.where("command = 'fetch' AND fault IS NULL").select("id", F.aggregate(parts, F.lit("").cast("binary"), lambda a, x: F.concat(a, x)).alias("body"))


#: What each service says it can do, and the name that stands for no refs.
RECEIVES = "report-status report-status-v2 delete-refs side-band-64k atomic ofs-delta push-options object-format=sha1"
UPLOADS = "multi_ack_detailed thin-pack side-band-64k ofs-delta"
UPLOADS_2 = ("ls-refs=unborn", "fetch", "object-format=sha1")
NO_REFS, ZERO_ID = "capabilities^{}", "0" * 40


def advertisement(refs: DataFrame, heads: DataFrame, agent: str, service: str = "upload-pack", version: int = 0, shallow: DataFrame | None = None) -> DataFrame:
    """(repo_id, part, name, line) of what a service first says; lines concatenated by part and name are the body.

    refs are (repo_id, name, oid, peeled), heads (repo_id, kind, target): one row a repository. receive-pack names refs alone;
    upload-pack names HEAD first, if it resolves, a peeled tag after its tag, and boundaries. The first ref line carries the
    capabilities; without refs it names none. Version 2 names commands only.
    """
    of = heads.select("repo_id")
    say = lambda df, part, text, name=F.lit(""): df.select("repo_id", F.lit(part).alias("part"), name.alias("name"), pkt_line(F.concat(text, F.lit("\n"))).alias("line"))
    flush = lambda part: of.select("repo_id", F.lit(part).alias("part"), F.lit("").alias("name"), F.lit(FLUSH).cast("binary").alias("line"))
    if service == "upload-pack" and version == 2:
        out = say(of, 0, F.lit("version 2"))
        for k, capability in enumerate((f"agent={agent}", *UPLOADS_2)):
            out = out.unionByName(say(of, k + 1, F.lit(capability)))
        return out.unionByName(flush(9))
    out = say(of, 0, F.lit(f"# service=git-{service}")).unionByName(flush(1))
    rows = refs.select("repo_id", "name", "oid")
    capabilities = of.select("repo_id", F.lit(f"{RECEIVES} agent={agent}").alias("capabilities"))
    if service == "upload-pack":
        if version == 1:
            out = out.unionByName(say(of, 2, F.lit("version 1")))
        rows = rows.unionByName(refs.where("peeled IS NOT NULL AND startswith(name, 'refs/tags/')").select("repo_id", F.concat("name", F.lit("^{}")).alias("name"), F.col("peeled").alias("oid")))
        named = heads.join(refs.select("repo_id", F.col("name").alias("target"), "oid"), ["repo_id", "target"], "left")
        at = F.when(F.col("kind") == "detached", F.col("target")).otherwise(F.col("oid"))
        rows = named.select("repo_id", F.lit("HEAD").alias("name"), at.alias("oid")).where("oid IS NOT NULL").unionByName(rows)
        grafts = of.limit(0).select("repo_id", F.lit("").alias("oid")) if shallow is None else shallow.select("repo_id", "oid").distinct()
        has = grafts.select("repo_id").distinct().withColumn("some", F.lit(" shallow"))
        symref = F.when(F.col("kind") == "symbolic", F.concat(F.lit(" symref=HEAD:"), "target")).otherwise("")
        capabilities = heads.join(has, "repo_id", "left").select("repo_id", F.concat(F.lit(UPLOADS), F.coalesce("some", F.lit("")), F.lit(f" object-format=sha1 agent={agent}"), symref).alias("capabilities"))
        out = out.unionByName(say(grafts, 4, F.concat(F.lit("shallow "), "oid"), F.col("oid")))
    first = rows.groupBy("repo_id").agg(F.min(F.struct(F.col("name") != "HEAD", "name")).alias("first")).select("repo_id", F.col("first.name").alias("first"))
    rows = rows.join(first, "repo_id").join(capabilities, "repo_id")
    text = F.concat("oid", F.lit(" "), "name", F.when(F.col("name") == F.col("first"), F.concat(F.lit("\0"), "capabilities")).otherwise(""))
    order = F.when(F.col("name") == "HEAD", "").otherwise(F.regexp_replace("name", r"\^\{\}$", "\0"))
    none = capabilities.join(first, "repo_id", "left_anti")
    return out.unionByName(say(rows, 3, text, order)).unionByName(say(none, 3, F.concat(F.lit(f"{ZERO_ID} {NO_REFS}\0"), "capabilities"))).unionByName(flush(5))


def fetch_lines(rows: DataFrame) -> DataFrame:
    """(id, pos, verb, value, capabilities, fault) of fetch requests: want, shallow and deepen before the first flush, have and done after it.

    Wants stand before all others; a depth of 0 is none. What follows done is not read.
    """
    text = F.regexp_replace(F.col("payload").cast("string"), "\n$", "")
    verb = F.regexp_extract(text, f"^(want(?= {OID}( |$))|(?:shallow|have)(?= {OID}$)|deepen(?= [0-9]+$)|done$)", 1)
    by = Window.partitionBy("id").orderBy("pos")
    lines = sections(rows).where("kind = 'line'").withColumn("text", text).withColumn("verb", verb)
    lines = lines.withColumn("other", F.max((F.col("verb") != "want").cast("int")).over(by)).withColumn("deep", F.coalesce(F.max((F.col("verb") == "deepen").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lines = lines.withColumn("ended", F.coalesce(F.max((F.col("verb") == "done").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("ended = 0")
    upper = F.col("section") == 0
    good = F.when(upper, ((F.col("verb") == "want") & (F.col("other") == 0)) | (F.col("verb").isin("shallow", "deepen") & (F.col("deep") == 0))).otherwise(F.col("verb").isin("have", "done"))
    value = F.get(F.split("text", " "), F.lit(1))
    capabilities = F.when(F.col("verb") == "want", F.filter(F.slice(F.split("text", " "), 3, 1_000_000), lambda c: c != ""))
    return lines.select("id", "pos", "verb", value.alias("value"), capabilities.alias("capabilities"), F.when(~good, "malformed").alias("fault"))


def one_line(text: Column) -> Column:
    """text with control characters as blanks, trimmed."""
    return F.trim(F.regexp_replace(text, "[\\x00-\\x1f\\x7f]", " "))


def banded(band: int, raw: Column) -> Column:
    return pkt_line(F.concat(F.unhex(F.lit(f"{band:02x}")), raw.cast("binary")))


def push_report(commands: DataFrame, side_band: bool = False) -> DataFrame:
    """(repo_id, push_id, part, line) of push reports: ``unpack``, then ok or ng of each command by pos, then a flush.

    commands are (repo_id, push_id, pos, name, reason, unpack). Concatenated by part, the lines are the body. With a
    side band every line, the report's flush too, is wrapped in the data band, and a further flush ends the stream.
    """
    status = F.when(F.col("reason").isNull(), F.concat(F.lit("ok "), one_line(F.col("name")), F.lit("\n"))).otherwise(F.concat(F.lit("ng "), one_line(F.col("name")), F.lit(" "), one_line(F.col("reason")), F.lit("\n")))
    key = ["repo_id", "push_id"]
    lines = commands.select(*key, F.col("pos").alias("part"), pkt_line(status).alias("line"))
    ends = commands.groupBy(*key).agg(F.min("unpack").alias("unpack"), F.max("pos").alias("last"))
    first = ends.select(*key, F.lit(-1).cast("long").alias("part"), pkt_line(F.concat(F.lit("unpack "), one_line(F.col("unpack")), F.lit("\n"))).alias("line"))
    flush = ends.select(*key, (F.col("last") + 1).alias("part"), F.lit(FLUSH).cast("binary").alias("line"))
    out = first.unionByName(lines).unionByName(flush)
    if not side_band:
        return out
    return out.withColumn("line", banded(DATA_BAND, F.col("line"))).unionByName(ends.select(*key, (F.col("last") + 2).alias("part"), F.lit(FLUSH).cast("binary").alias("line")))


def ref_lines(refs: DataFrame, heads: DataFrame, prefixes: tuple[str, ...] = (), symrefs: bool = True, unborn: bool = True, peel: bool = True) -> DataFrame:
    """(repo_id, part, name, line) of ref listings: HEAD (part 0), refs (part 1, by name), flush (part 2).

    refs are (repo_id, name, oid, peeled), heads (repo_id, kind, target). A HEAD that names no ref is ``unborn`` if asked for.
    """
    chosen = lambda name: F.lit(True) if not prefixes else F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(name, p))
    end = F.when(F.col("peeled").isNotNull() & F.lit(peel), F.concat(F.lit(" peeled:"), "peeled")).otherwise("")
    listed = refs.where(chosen(F.col("name"))).select("repo_id", F.lit(1).alias("part"), "name", F.concat("oid", F.lit(" "), "name", end, F.lit("\n")).alias("text"))
    own = heads.join(refs.select("repo_id", F.col("name").alias("target"), "oid"), ["repo_id", "target"], "left")
    to = F.concat(F.lit(" symref-target:"), "target")
    head = (F.when(F.col("kind") == "detached", F.concat("target", F.lit(" HEAD\n")))
            .when(F.col("oid").isNotNull(), F.concat("oid", F.lit(" HEAD"), to if symrefs else F.lit(""), F.lit("\n")))
            .when(F.lit(unborn), F.concat(F.lit("unborn HEAD"), to, F.lit("\n"))))
    top = own.where(chosen(F.lit("HEAD"))).select("repo_id", F.lit(0).alias("part"), F.lit("HEAD").alias("name"), head.alias("text")).where("text IS NOT NULL")
    ends = heads.select("repo_id", F.lit(2).alias("part"), F.lit("").alias("name"), F.lit(FLUSH).cast("binary").alias("line"))
    return top.unionByName(listed).select("repo_id", "part", "name", pkt_line(F.col("text")).alias("line")).unionByName(ends)


def encode_cursor(*key: Column | str) -> Column:
    """A page cursor: the JSON of the key columns in URL-safe base64 without padding."""
    raw = F.base64(F.to_json(F.struct(*key)).cast("binary"))
    return F.rtrim(F.translate(F.regexp_replace(raw, "\\s", ""), "+/", "-_"), F.lit("="))


def bound_cursor(cursor: Column, schema: str, asked: dict[str, str]) -> Column:
    """(key, fault) of a cursor: null and empty start at the beginning; one that is none is ``bad-cursor``, one made for another
    sort, direction or search, which ``asked`` names, ``query-mismatch``."""
    key = decode_cursor(cursor, schema)
    same = reduce(lambda a, b: a & b, (key[name] == value for name, value in asked.items()), F.lit(True))
    start = F.coalesce(cursor == "", F.lit(True))
    fault = F.when(start, F.lit(None).cast("string")).when(key.isNull(), "bad-cursor").when(~same, "query-mismatch")
    return F.struct(F.when(~start & fault.isNull(), key).alias("key"), fault.alias("fault"))


def progress(text: Column) -> Column:
    """A line of the progress band, for people to read."""
    return banded(2, text)


def decode_cursor(cursor: Column, schema: str) -> Column:
    """The key of a cursor as a struct of text columns; null if it is none, so that a caller can refuse it."""
    plain = F.translate(cursor, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4))))
    found = F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), schema)
    names = [part.split()[0] for part in schema.split(",")]
    whole = F.lit(True)
    for name in names:
        whole = whole & found[name].isNotNull()
    return F.when(cursor.rlike("^[A-Za-z0-9_-]+$") & whole, found)


@F.pandas_udf(BinaryType())
def gunzipped(body: pd.Series) -> pd.Series:
    """The content of a gzip body of one member; null for a body that is none, is followed by more, or passes the bound."""
    def one(raw) -> bytes | None:
        if raw is None or len(raw) > BODY:
            return None
        stream = zlib.decompressobj(wbits=31)
        try:
            out = stream.decompress(bytes(raw), BODY + 1)
        except zlib.error:
            return None
        return out if stream.eof and not stream.unused_data and len(out) <= BODY else None

    return body.map(one, na_action=None)
