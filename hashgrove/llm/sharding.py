"""K-d tree sharding: recursive splits at distributed weighted medians of the widest metadata dimension."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hashgrove.llm.shared import staged, unstage

#: Bins of one histogram and of all histograms of a round; share of a leaf that a cut may be off by.
BINS, ROUND_BINS, TOLERANCE = 4096, 1 << 24, 0.002
#: Rows of a range small enough to be summed row by row; levels between two written tables; rows of a bucket that one task numbers.
FEW_ROWS, LEVELS, SLOT_ROWS = 1 << 14, 4, 50_000
DIMS = ("log_size", "multi_byte")
#: A coordinate is a step of its scale, then 32 bits of text checksum: equal texts meet at one point, others hardly do.
TIE_BITS, STEPS = 32, 1 << 16
PARTS = ("x", "__row", "__seq")


@dataclass
class Node:
    """An open node: it covers shards first .. first+count-1; ``spans`` has a range of each dimension that holds its rows."""

    first: int
    count: int
    spans: tuple[tuple[int, int], ...]


@dataclass
class Search:
    """Narrowing of a node's cut in one dimension: the range of the current key part, the weight still to pass, the parts fixed so far."""

    node: Node
    dim: int
    low: int
    high: int
    need: int = 0
    fixed: tuple[int, ...] = ()
    rows: int | None = None


def local_table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small table of longs from the driver: one row an open node and dimension at most."""
    columns = list(zip(*rows))
    return spark.createDataFrame(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names.split(), columns)}))


def coordinate(dims: tuple[str, ...], dim: Column) -> Column:
    out = F.col(dims[-1])
    for k, name in enumerate(dims[:-1]):
        out = F.when(dim == k, F.col(name)).otherwise(out)
    return out


def histograms(rows: DataFrame, dims: tuple[str, ...], searches: list[Search]) -> dict[tuple[int, int], object]:
    """For each search, the bin in which its weight is reached: one row each is collected.

    Bins are summed before the shuffle; a window over the bins of a node, on the executors, picks the one. A range of at most
    FEW_ROWS rows has each row as a bin of its own, ``x``, ``row``, ``seq``. ``lo`` and ``hi`` are the bin's bounds in the
    current part, ``nlo`` and ``nhi`` in the next, ``least`` and ``most`` those of all bins.
    """
    bins = max(64, min(BINS, ROUND_BINS // len(searches)))
    few = lambda s: int(s.rows is not None and s.rows <= FEW_ROWS)
    table = local_table(rows.sparkSession, [(s.node.first, s.dim, few(s), len(s.fixed), s.low, s.high, s.node.count, s.need, *[*s.fixed, 0, 0][:2]) for s in searches], "node dim few part low high count need f0 f1")
    joined = rows.join(F.broadcast(table), "node").withColumn("x", coordinate(dims, F.col("dim")))
    part = F.when(F.col("part") == 0, F.col("x")).when(F.col("part") == 1, F.col("__row")).otherwise(F.col("__seq"))
    after = F.when(F.col("part") == 0, F.col("__row")).otherwise(F.col("__seq"))
    inside = (F.col("part") == 0) | (F.col("x") == F.col("f0")) & ((F.col("part") == 1) | (F.col("__row") == F.col("f1")))
    joined = joined.where(inside).withColumns({"v": part, "v2": after}).where("v BETWEEN low AND high")
    place = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low") + 1).cast("double") * bins), F.lit(bins - 1))
    key = [F.when(F.col("few") == 1, F.col(c)).otherwise(other).alias(name) for c, other, name in zip(PARTS, (place, F.lit(0), F.lit(0)), ("bin", "row", "seq"))]
    binned = joined.groupBy("node", "dim", *key).agg(
        F.sum("size").alias("w"), F.count("*").alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("v2").alias("nlo"), F.max("v2").alias("nhi"), F.first("need").alias("need"), F.first("count").alias("count"), F.first("few").alias("few"))
    all_, before = Window.partitionBy("node", "dim"), Window.partitionBy("node", "dim").orderBy("bin", "row", "seq").rowsBetween(Window.unboundedPreceding, -1)
    summed = binned.withColumns({"passed": F.coalesce(F.sum("w").over(before), F.lit(0)), "total": F.sum("w").over(all_), "least": F.min("lo").over(all_), "most": F.max("hi").over(all_)})
    need = F.when(F.col("need") > 0, F.col("need")).otherwise(F.greatest(F.lit(1), F.expr("total * (count DIV 2) DIV count")))
    return {(r.node, r.dim): r for r in summed.withColumn("need", need).where("passed < need AND need <= passed + w").collect()}


def find_cuts(rows: DataFrame, dims: tuple[str, ...], nodes: list[Node], spread: list[int], tolerance: float) -> list[tuple[int, ...]]:
    """(node, dim, x, row, seq, right) of each node that holds rows: rows before the key go left. Sets the spans of the nodes."""
    searches = [Search(n, d, *n.spans[d]) for n in nodes for d in range(len(dims))]
    found, cuts = histograms(rows, dims, searches), []
    todo = []
    for n in nodes:
        if (n.first, 0) in found:
            n.spans = tuple((found[n.first, d].least, found[n.first, d].most) for d in range(len(dims)))
            todo.append(Search(n, max(range(len(dims)), key=lambda d: (n.spans[d][1] - n.spans[d][0]) / spread[d]), 0, 0))
    while todo:
        rest = []
        for s in todo:
            r = found[s.node.first, s.dim]
            need = r.need - r.passed
            if r.few:
                cuts.append((s.node.first, s.dim, r.bin, r.row, r.seq + (2 * need > r.w), s.node.first + s.node.count // 2))
            elif r.w <= tolerance or r.lo == r.hi and len(s.fixed) == len(PARTS) - 1:
                key = (*s.fixed, r.hi + 1 if 2 * need > r.w else r.lo, 0, 0)[: len(PARTS)]
                cuts.append((s.node.first, s.dim, *key, s.node.first + s.node.count // 2))
            elif r.lo == r.hi:
                rest.append(replace(s, low=r.nlo, high=r.nhi, need=need, fixed=(*s.fixed, r.lo), rows=r.rows))
            else:
                rest.append(replace(s, low=r.lo, high=r.hi, need=need, rows=r.rows))
        todo = rest
        found = histograms(rows, dims, todo) if todo else {}
    return cuts


def descend(rows: DataFrame, dims: tuple[str, ...], cuts: list[tuple[int, ...]]) -> DataFrame:
    """rows with ``node`` moved one level down; the broadcast table has one row a cut."""
    table = local_table(rows.sparkSession, cuts, "node dim c0 c1 c2 right")
    x = coordinate(dims, F.col("dim"))
    left = (x < F.col("c0")) | (x == F.col("c0")) & ((F.col("__row") < F.col("c1")) | (F.col("__row") == F.col("c1")) & (F.col("__seq") < F.col("c2")))
    return rows.join(F.broadcast(table), "node", "left").withColumn("node", F.when(F.col("right").isNull() | left, F.col("node")).otherwise(F.col("right"))).drop("dim", "c0", "c1", "c2", "right")


def kd_tree(rows: DataFrame, dims: tuple[str, ...], shards: int, tolerance: float = TOLERANCE) -> DataFrame:
    """rows (whole-number dims, size, __row, __seq) with the leaf of each as ``node``, 0 to shards-1, of near equal total size.

    A node that stands for k leaves is split along the dimension whose range among its rows is widest, as a share of
    the range of all rows, where k//2 of k parts of the size have passed, within ``tolerance`` of a leaf. Rows of equal
    coordinates are told apart by __row, then by __seq, so that one point may hold any share of the size. All nodes
    of a level are searched at once. One row a node reaches the driver in each round; histograms do not. An empty table stays empty.
    """
    shape = rows.agg(F.sum("size"), *(f(d) for d in dims for f in (F.min, F.max))).first()
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    if shape[0] is None:
        return rows
    spans = tuple((shape[2 * k + 1], shape[2 * k + 2]) for k in range(len(dims)))
    spread, level, kept = [hi - lo or 1 for lo, hi in spans], 0, None
    todo = [Node(0, shards, spans)] if shards > 1 else []
    while todo:
        cuts = find_cuts(rows, dims, todo, spread, tolerance * shape[0] / shards)
        by, after = {c[0]: c for c in cuts}, []
        for n in todo:
            if n.first in by:
                _, dim, x, *_ = by[n.first]
                half, (lo, hi) = n.count // 2, n.spans[dim]
                for first, count, span in ((n.first, half, (lo, min(x, hi))), (n.first + half, n.count - half, (max(x, lo), hi))):
                    if count > 1 and span[0] <= span[1]:
                        after.append(Node(first, count, (*n.spans[:dim], span, *n.spans[dim + 1 :])))
        todo, level = after, level + 1
        if cuts:
            rows = descend(rows, dims, cuts)
        if level % LEVELS == 0 and todo:
            rows, before = staged(rows, "kd-rows"), kept
            if before is not None:
                unstage(before)
            kept = rows
    return rows


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the coordinates, and what tells rows of one point apart: a hash of id and checksum, then a row number of this table."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    share = F.when(F.octet_length("text") > 0, 1 - F.length("text") / F.octet_length("text")).otherwise(F.lit(0.0))
    step = lambda c: F.shiftleft(F.floor(c), TIE_BITS) + F.col("text_crc32")
    base = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), share.alias("share"))
    return base.select("doc_id", "size", "text_crc32", step(F.log2(F.col("size").cast("double")) * 1024).alias("log_size"), step(F.col("share") * (STEPS - 1)).alias("multi_byte"),
                       F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(1 << 48)).alias("__row"), F.monotonically_increasing_id().alias("__seq"))


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of docs (doc_id, text).

    The tree splits on log size and share of multi-byte text until ``shards`` leaves (or leaves of about
    ``target_bytes``) remain; sizes come within a percent of equal, as far as single documents allow. Equal texts have
    equal coordinates, so they share a shard unless a cut must fall inside their group; rows of equal text and id are
    numbered in a written table, so such a group is cut like any. Null and empty texts weigh 8 bytes; null ids are
    ordinary; repeated rows each get a slot; an empty table gives no rows; other columns are not read. Slots are
    numbered inside buckets of about SLOT_ROWS rows and shifted by the buckets before, so no task holds a shard.
    """
    base = staged(points(docs), "kd-points")
    if shards is None:
        shards = max(1, math.ceil((base.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    placed = kd_tree(base, DIMS, shards, tolerance).select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard"), "__row", "__seq")
    counts = placed.groupBy("shard").agg(F.ceil(F.count("*") / SLOT_ROWS).alias("buckets"))
    placed = placed.join(F.broadcast(counts), "shard").withColumn("bucket", F.pmod(F.xxhash64("__row", "__seq"), F.col("buckets"))).drop("buckets")
    before = placed.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = before.withColumn("before", F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("rows")
    slot = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("__row", "__seq")) - 1
    return placed.withColumn("slot", slot).join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("before")).cast("long").alias("slot"))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op8: 24 shards of near equal bytes."""
    return shard_documents(docs, shards=24).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
