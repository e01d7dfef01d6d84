"""Order of a pack, windows in which its entries are read, and the choice of deltas."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashgrove.functions import codec
from hashgrove.functions.codec import build_delta
from hashgrove.functions.names import object_id, size_bucket
from hashgrove.plans.staging import counted_cut, cut

#: Bounds of one read window; a delta with its 20-byte base id must stay below this share of the whole entry.
WINDOW_BYTES, WINDOW_KEYS, SHARE, ID_BYTES = 8 << 20, 96, 0.875, 20


def ranked(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """rows with their number from 0 in ``order`` within ``group``, without a task that holds a whole group.

    A global sort cuts the rows into ranges; each range numbers its own rows of a group, and the rows of the group in the
    ranges before are added: one count a range and group.
    """
    cut_up = cut(rows.orderBy(group, *order).withColumn("__part", F.spark_partition_id()))
    counts = cut_up.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order)) - 1
    return cut_up.withColumn("__own", own).join(counts.withColumn("__before", before).drop("__n"), [group, "__part"]).withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def pack_order(objects: DataFrame, deltas: DataFrame) -> DataFrame:
    """(repo_id, oid, place, base) of objects (repo_id, oid, pos): every delta after its base, else first come, first served.

    deltas are (repo_id, oid, base). Every object has one base at most, so the order is that of levels of a forest, and
    within a level that of the positions on the way from its root. Objects on cycles come last, by pos. One round a level of
    the longest chain.
    """
    own = objects.groupBy("repo_id", "oid").agg(F.min("pos").alias("pos")).join(deltas.select("repo_id", "oid", "base"), ["repo_id", "oid"], "left")
    own = cut(own)
    ids = own.select("repo_id", F.col("oid").alias("base"))
    below = cut(own.where("base <> oid").join(ids, ["repo_id", "base"], "left_semi").select("repo_id", "oid", "pos", "base"))
    level = 0
    frontier = cut(own.join(below.select("repo_id", "oid"), ["repo_id", "oid"], "left_anti").select("repo_id", "oid", F.lit(0).alias("level"), F.array("pos").alias("way")))
    done = frontier
    while not frontier.isEmpty():
        level += 1
        step = below.join(frontier.select("repo_id", F.col("oid").alias("base"), "way"), ["repo_id", "base"])
        frontier = cut(step.select("repo_id", "oid", F.lit(level).alias("level"), F.concat("way", F.array("pos")).alias("way")))
        done = done.unionByName(frontier)
    rows = own.join(done, ["repo_id", "oid"], "left")
    return ranked(rows, "repo_id", [F.asc_nulls_last("level"), F.asc("way"), F.asc("pos")], "place").select("repo_id", "oid", F.col("place").cast("int").alias("place"), "base")


def read_windows(order: DataFrame, stored: DataFrame, client: DataFrame | None = None, max_bytes: int = WINDOW_BYTES, max_keys: int = WINDOW_KEYS) -> DataFrame:
    """order (repo_id, oid, place, base) with the ``window`` that each entry is read in, ``as_delta`` and its ``size``.

    stored has full_size, full_keys, delta_size, delta_keys of each (repo_id, oid), null for what is not held. A delta is
    read if its base stands earlier or, for a thin pack, is among client (repo_id, oid). A window takes entries while they
    fit both bounds; a larger entry is alone. Rows stream through a task that holds two sums.
    """
    base = order.select("repo_id", F.col("oid").alias("base"), F.col("place").alias("__base_place"))
    rows = order.join(base, ["repo_id", "base"], "left").join(stored, ["repo_id", "oid"], "left")
    ready = F.coalesce(F.col("__base_place") < F.col("place"), F.lit(False))
    if client is not None:
        rows = rows.join(client.select("repo_id", F.col("oid").alias("base")).distinct().withColumn("__held", F.lit(True)), ["repo_id", "base"], "left")
        ready = ready | F.col("__held").isNotNull()
    as_delta = ready & F.col("delta_size").isNotNull()
    rows = rows.select("repo_id", "place", "oid", as_delta.alias("as_delta"), F.when(as_delta, F.col("delta_size")).otherwise(F.col("full_size")).cast("long").alias("size"), F.when(as_delta, F.col("delta_keys")).otherwise(F.col("full_keys")).cast("long").alias("keys"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repo, window, total, keys = None, 0, 0, 0
        for pdf in batches:
            out = []
            for r, size, n in zip(pdf.repo_id, pdf["size"], pdf["keys"]):
                if r != repo:
                    repo, window, total, keys, any_read = r, 0, 0, 0, False
                if not pd.isna(size):
                    if any_read and (total + size > max_bytes or keys + n > max_keys):
                        window, total, keys = window + 1, 0, 0
                    total, keys, any_read = total + size, keys + n, True
                out.append(window)
            yield pdf[["repo_id", "place", "oid", "as_delta", "size"]].assign(window=out)

    return rows.repartition("repo_id").sortWithinPartitions("repo_id", "place").mapInPandas(run, "repo_id long, place int, oid string, as_delta boolean, size long, window int")


def select_deltas(objects: DataFrame, memory: int = 96 << 20) -> DataFrame:
    """(repo_id, oid, base, delta) of the objects (repo_id, oid, type, bytes, base) worth storing as deltas.

    By oid, within a repository and a size bucket, each object that is no delta yet is tried against the last one that
    stayed whole, if both and the delta fit ``memory``; it is chosen if its deflated delta is below the share of
    its deflated self, and never becomes a base. Rows stream through a task that holds one object.
    """
    rows = objects.select("repo_id", "oid", "bytes", "base", size_bucket(F.col("type"), F.octet_length("bytes")).alias("bucket"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, last = None, None
        for pdf in batches:
            out = []
            for repo, bucket, oid, raw, base in zip(pdf.repo_id, pdf.bucket, pdf.oid, pdf.bytes, pdf.base):
                if (repo, bucket) != group:
                    group, last = (repo, bucket), None
                if base is not None:
                    continue
                raw = bytes(raw)
                if last and last[0] != oid and needed_memory(len(last[1]), len(raw)) <= memory:
                    delta = build_delta(last[1], raw)
                    if len(zlib.compress(delta)) + ID_BYTES < SHARE * len(zlib.compress(raw)):
                        out.append((repo, oid, last[0], delta))
                        continue
                last = (oid, raw)
            yield pd.DataFrame(out, columns=["repo_id", "oid", "base", "delta"])

    return rows.repartition("repo_id", "bucket").sortWithinPartitions("repo_id", "bucket", "oid").mapInPandas(run, "repo_id long, oid string, base string, delta binary")


def needed_memory(base: int, target: int) -> int:
    """Bytes held while a delta is chosen: both texts, the delta at its worst, and its deflated form at its worst."""
    delta = target + -(-target // 127) + 32
    return base + target + delta + delta + -(-delta // 4_096) + -(-delta // 16_384) + -(-delta // 33_554_432) + 13


def unpacked(packs: DataFrame, stored: DataFrame | None = None, column: str = "content") -> DataFrame:
    """(path, pos, oid, type, bytes, fault) of the objects of packs (path, content); one row a pack at fault, with its fault alone.

    Whole entries are objects at once; deltas wait for their base: an earlier entry, by place or id, or one of stored
    (oid, type, bytes), for thin packs. Each round resolves all deltas whose bases are known, with one join, so a
    pack's objects are spread over tasks. A delta whose base is nowhere is ``missing-base``, one that does not fit it
    ``corrupt``. Repeated paths are told apart by nothing: give each pack one.
    """
    entries = cut(codec.pack_entries(packs, column))
    bad = entries.where("fault IS NOT NULL").select("path", "fault")
    number = F.create_map(*[F.lit(x) for pair in codec.KINDS.items() for x in pair])
    good = entries.where("fault IS NULL").join(bad.select("path"), "path", "left_anti")
    named = lambda df: df.select("path", "pos", "place", object_id(F.col("type"), F.col("bytes")).alias("oid"), "type", "bytes")
    done = cut(named(good.where(f"kind < {codec.OFS_DELTA}").select("path", "pos", "place", number[F.col("kind")].alias("type"), F.col("body").alias("bytes"))))
    open_, left = counted_cut(good.where(f"kind >= {codec.OFS_DELTA}").select("path", "pos", "place", "base_place", "base_id", "body"))
    frontier, parts = done, [done]
    outside = None if stored is None else stored.select(F.col("oid").alias("base_id"), F.col("type").alias("base_type"), F.col("bytes").alias("base"))
    wrong = entries.select("path", F.lit("corrupt").alias("fault")).limit(0)
    first = True
    while left:
        by_place = frontier.select("path", F.col("place").alias("base_place"), F.col("type").alias("t1"), F.col("bytes").alias("b1"))
        by_id = frontier.groupBy("path", F.col("oid").alias("base_id")).agg(F.first(F.struct("type", "bytes")).alias("s")).select("path", "base_id", F.col("s.type").alias("t2"), F.col("s.bytes").alias("b2"))
        step = open_.join(by_place, ["path", "base_place"], "left").join(by_id, ["path", "base_id"], "left")
        base, kind = F.coalesce("b1", "b2"), F.coalesce("t1", "t2")
        if first and outside is not None:
            step = step.join(outside, "base_id", "left")
            base, kind = F.coalesce(base, F.col("base")), F.coalesce(kind, F.col("base_type"))
        step = step.withColumns({"type": kind, "bytes": F.when(kind.isNotNull(), codec.patched_or_null(base, F.col("body")))})
        step, more = counted_cut(step.select("path", "pos", "place", "base_place", "base_id", "body", "type", "bytes"), "type IS NULL")
        frontier = cut(named(step.where("bytes IS NOT NULL")))
        parts.append(frontier)
        wrong = wrong.unionByName(step.where("type IS NOT NULL AND bytes IS NULL").select("path", F.lit("corrupt").alias("fault")))
        open_, first = step.where("type IS NULL").drop("type", "bytes"), False
        if more == left:
            break
        left = more
    if left:
        wrong = wrong.unionByName(open_.select("path", F.lit("missing-base").alias("fault")))
    faults = bad.unionByName(wrong).groupBy("path").agg(F.min("fault").alias("fault"))
    objects = reduce(DataFrame.unionByName, parts).join(faults.select("path"), "path", "left_anti")
    none = F.lit(None).cast("string")
    return objects.select("path", "pos", "oid", "type", "bytes", none.alias("fault")).unionByName(faults.select("path", F.lit(-1).alias("pos"), none.alias("oid"), none.alias("type"), none.cast("binary").alias("bytes"), "fault"))


#: Bytes of payload in one line of the side band, and its bands.
BAND_BYTES, DATA, PROGRESS = 65_515, 1, 2


def pack_stream(entries: DataFrame, band: bool = False) -> DataFrame:
    """(repo_id, part, frame) of one pack a repository from entries (repo_id, place, type, bytes, base): what is to be sent, in order of part.

    ``bytes`` is an object, or with ``base`` the delta on the object of that id. Entries are encoded where they stand; the
    order, the count and the running SHA-1 of a pack are sequential, so a repository's encoded entries stream through
    one task, which holds one frame. With ``band`` frames are lines of the data band, ended by a flush. A
    repository without entries sends nothing.
    """
    @F.pandas_udf("binary")
    def encoded(kind: pd.Series, raw: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([codec.pack_entry(k, bytes(r), b) for k, r, b in zip(kind, raw, base)])

    counts = entries.groupBy("repo_id").agg(F.count("*").alias("n"))
    rows = entries.select("repo_id", "place", encoded("type", "bytes", "base").alias("entry")).join(counts, "repo_id")

    def lines(data: bytes) -> bytes:
        return f"{len(data) + 5:04x}".encode() + bytes([DATA]) + data if band else data

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = chain.from_iterable(zip(b.repo_id, b.n, b.entry) for b in batches)
        for repo, own in groupby(stream, key=lambda r: r[0]):
            digest, held, part, head = hashlib.sha1(), bytearray(), 0, True
            for _, n, entry in own:
                data = (codec.pack_head(n) if head else b"") + bytes(entry)
                head = False
                digest.update(data)
                held += data
                while len(held) >= BAND_BYTES:
                    yield pd.DataFrame([(repo, part, lines(bytes(held[:BAND_BYTES])))], columns=["repo_id", "part", "frame"])
                    del held[:BAND_BYTES]
                    part += 1
            held += digest.digest()
            last = [(repo, part + k // BAND_BYTES, lines(bytes(held[k : k + BAND_BYTES]))) for k in range(0, len(held), BAND_BYTES)]
            yield pd.DataFrame([*last, *([(repo, last[-1][1] + 1, b"0000")] if band else [])], columns=["repo_id", "part", "frame"])

    return rows.repartition("repo_id").sortWithinPartitions("repo_id", "place").mapInPandas(run, "repo_id long, part long, frame binary")
