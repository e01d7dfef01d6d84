"""SpotSigs: chains of content words that follow common-word anchors are a document's signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashgrove.llm.shared import staged
from hashgrove.llm.words import U64, Words, chunks, distinct, mix, pieces, spans_hash

#: Common words that anchor a spot, in four languages.
ANCHORS = (
    "the a is be that of to was this with "
    "der die das ein ist nicht und von mit dem "
    "le la les un une est des que pour dans "
    "el los las una es de por con para se"
).split()
CHAIN, THRESHOLD = 3, 0.75
#: How many of the commonest signatures stand last in the order of prefixes: the bound of what is broadcast.
FREQUENT = 100_000
LOWEST = -(1 << 63)

_anchor_hash: np.ndarray | None = None


def anchor_hashes() -> np.ndarray:
    global _anchor_hash
    if _anchor_hash is None:
        w = Words([" ".join(sorted(set(ANCHORS))).encode()])
        _anchor_hash = np.sort(w.hash)
    return _anchor_hash


def spot_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct 32-bit signatures of each text: an anchor and the CHAIN content words after it.

    A text without a whole spot gives one signature of all its words, so equal texts have equal sets;
    a text without words gives the empty set.
    """
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        w = Words(texts[a:b], lower=True, letters=True)
        table = anchor_hashes()
        at = np.minimum(np.searchsorted(table, w.hash), len(table) - 1)
        anchor = table[at] == w.hash
        content = np.flatnonzero(~anchor)
        order = np.concatenate(([0], np.cumsum(~anchor)))
        spots = np.flatnonzero(anchor)
        text = w.text_of()
        first = order[spots + 1]
        limit = order[w.bound[1:]][text[spots]] if len(spots) else first
        whole = first + CHAIN <= limit
        spots, first = spots[whole], first[whole]
        chain = spans_hash(w.hash[content], first, first + CHAIN)
        sig = (mix(chain + w.hash[spots] * U64(3)) >> U64(32)).astype(np.uint32)
        cut = np.searchsorted(spots, w.bound)
        full = (spans_hash(w.hash, w.bound[:-1], w.bound[1:]) >> U64(32)).astype(np.uint32)
        for i in range(b - a):
            if cut[i + 1] > cut[i]:
                out.append(distinct(sig[cut[i] : cut[i + 1]]))
            else:
                out.append(full[i : i + 1] if w.bound[i + 1] > w.bound[i] else np.zeros(0, dtype=np.uint32))
    return out


def fingerprint(signatures: np.ndarray) -> str:
    """Eight hexadecimal digits for each signature, ascending."""
    return signatures.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets; two empty sets are alike. A pair whose lengths rule ``least`` out is 0 at once."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, oid, doc_id, text, tail) of docs for a per-part walk in descending doc_id order.

    Ids are cut into as many ranges as there are input splits, a hot id's rows further by their texts' hash; the head of
    every range is repeated, as ``tail``, at the end of the range before it (the first range's at the last), so each row finds
    its follower in its own part. A null doc_id comes last; ties stand in the order of their texts' hash. One bound and one
    head a split reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("oid"), F.bitwise_not(F.xxhash64("text")).alias("turned"), "doc_id", "text")
    parts = max(1, docs.rdd.getNumPartitions())
    cuts = rows.agg(F.percentile_approx("oid", [i / parts for i in range(1, parts)], 10 * max(1000, parts))).first()[0] if parts > 1 else []
    bounds = spark.sparkContext.broadcast(np.asarray(cuts or [], dtype=np.int64))

    @F.pandas_udf("long")
    def part_of(ids: pd.Series, turned: pd.Series) -> pd.Series:
        """Of the ranges that bounds of one id leave empty, each takes a share of that id's hashes."""
        cuts, own = bounds.value, ids.to_numpy()
        at = np.searchsorted(cuts, own, side="left")
        many = np.searchsorted(cuts, own, side="right") - at
        share = (turned.to_numpy() + 2.0**63) / 2.0**64
        return pd.Series(len(cuts) - at - np.minimum(np.floor(share * many), np.maximum(many - 1, 0)).astype(np.int64))

    rows = rows.withColumn("part", part_of("oid", "turned"))
    heads = sorted((r.part, r.top.oid, r.top.turned) for r in rows.groupBy("part").agg(F.max(F.struct("oid", "turned")).alias("top")).collect())
    before = [(p, oid, turned, heads[i - 1][0]) for i, (p, oid, turned) in enumerate(heads)]
    table = spark.createDataFrame(before, "part long, top long, first long, before long")
    own = F.struct(F.col("part"), F.lit(False).alias("tail"))
    heading = (F.col("oid") == F.col("top")) & (F.col("turned") == F.col("first"))
    places = F.when(heading, F.array(own, F.struct(F.col("before").alias("part"), F.lit(True).alias("tail")))).otherwise(F.array(own))
    rows = rows.join(F.broadcast(table), "part").select("oid", "turned", "doc_id", "text", F.explode(places).alias("p")).select("p.part", "p.tail", "oid", "turned", "doc_id", "text")
    return rows.repartitionByRange(parts, "part").sortWithinPartitions("part", "tail", F.desc("oid"), F.desc("turned"))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op5: every text against its edit and its follower in descending doc_id.

    Null texts count as empty; a lone document follows itself; whole texts are used; repeated rows each
    give a row; an empty table gives none.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def compare(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (doc_id, text, its signatures or None, next text)."""
        edits = []
        for _, text, follower in rows:
            m = len(text) // 3
            edits.append(text[: len(text) - m] + follower[:m])
        raw = [e.encode("utf-8", "surrogatepass") for e in edits]
        own = spot_sets([t.encode("utf-8", "surrogatepass") for _, t, _ in rows] + [rows[-1][2].encode("utf-8", "surrogatepass")])
        new = spot_sets(raw)
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array([fingerprint(s) for s in own[:-1]], pa.string()), pa.array([fingerprint(s) for s in new], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, new)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
        ], schema=schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pending, size = None, [], 0  # the row whose follower is still to come
        for batch in batches:
            columns = [batch.column(c) for c in ("part", "tail", "doc_id", "text")]
            for k in range(batch.num_rows):
                part, tail, doc_id, text = (c[k].as_py() for c in columns)
                text = text or ""
                if held is not None and held[0] == part:
                    if pending and pending[-1][2] is not held[2]:
                        yield compare(pending)
                        pending, size = [], 0
                    pending.append((held[1], held[2], text))
                    size += len(held[2])
                    if size > 1 << 20:
                        yield compare(pending)
                        pending, size = [], 0
                held = None if tail else (part, doc_id, text)
        if pending:
            yield compare(pending)

    return with_next(docs).select("part", "tail", "doc_id", "text").mapInArrow(walk, RESULT)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): doc_id, key and class_id of every row, and the pairs (a_key, b_key, a, b, likeness) of classes whose Jaccard reaches ``threshold``.

    A class is the rows of one signature set, ``key`` its digest, class_id (a, b) its least doc_id, null if it has none. Equal sets are collapsed
    first, so copies are never paired. Sets are partitioned by length range: a set probes its own range and the one
    below, as no farther length can reach the threshold, and only through signatures of its prefix, rare ones first, so no
    pair is lost. The FREQUENT commonest signatures, which stand last, are broadcast. Null and empty texts are classes of
    the empty set and pair with nothing; an empty table gives no rows; only doc_id and text are read.
    """
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in pieces(batch.column("text")):
                found = spot_sets(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([f.astype(np.int64) for f in found], pa.list_(pa.int64()))], names=["doc_id", "sigs"])

    found = staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sets, "doc_id long, sigs array<long>").withColumn("key", F.sha2(F.array_join(F.col("sigs").cast("array<string>"), ","), 256)), "spots")
    classes = staged(found.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.first("sigs").alias("sigs")), "spot-classes")
    some = classes.where(F.size("sigs") > 0)
    common = some.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("n")).where("n > 8").orderBy(F.desc("n"), "sig").limit(FREQUENT).collect()
    rank = docs.sparkSession.sparkContext.broadcast({r.sig: -k for k, r in enumerate(common, 1)})

    @F.pandas_udf("array<long>")
    def rare_first(sigs: pd.Series) -> pd.Series:
        order = rank.value
        return sigs.map(lambda s: sorted(s.tolist(), key=lambda x: (x in order, order.get(x, 0), x)))

    n = F.size("sigs")
    prefix = F.slice(rare_first("sigs"), 1, (n - F.ceil(n * threshold) + 1).cast("int"))
    band = F.floor(F.log(n.cast("double")) / float(-np.log(threshold)) + 1e-9)
    rows = staged(some.select("key", n.alias("n"), band.alias("band"), F.explode(prefix).alias("sig")), "spot-prefixes")
    left = rows.withColumn("band", F.explode(F.array("band", F.col("band") - 1)))
    a, b = left.alias("a"), rows.alias("b")
    pairs = a.join(b, ["band", "sig"]).where("(a.n > b.n OR (a.n = b.n AND a.key > b.key))").where(F.col("b.n") >= F.col("a.n") * threshold).select(F.col("a.key").alias("a_key"), F.col("b.key").alias("b_key")).distinct()
    x, y = (some.select(F.col("key").alias(f"{c}_key"), F.col("class_id").alias(c), F.col("sigs").alias(f"{c}_sigs")) for c in "ab")
    both = F.size(F.array_intersect("a_sigs", "b_sigs"))
    scored = pairs.join(x, "a_key").join(y, "b_key").select("a_key", "b_key", "a", "b", (both / (F.size("a_sigs") + F.size("b_sigs") - both)).alias("likeness")).where(F.col("likeness") >= threshold)
    return found.select("doc_id", "key").join(classes.select("key", "class_id"), "key").select("doc_id", "key", "class_id"), scored
