"""The life of stored objects as functions of snapshots: publish, read, reclaim, index, install deltas, keep compressed forms.

A store is three tables: objects (repo_id, oid, type, size, chunks, compressed_size, compressed_chunks, complete,
links_indexed), deltas (repo_id, oid, base, size, chunks, compressed_size, compressed_chunks) and pieces (repo_id, form, oid,
idx, bytes). Each function returns new tables; a caller publishes them at once, so a lost job leaves the old ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashgrove.functions.codec import deflated
from hashgrove.functions.objects import object_links

KEY = ["repo_id", "oid"]
#: Fixed value: bytes of one piece.
CHUNK = 16_384
OBJECT = "repo_id long, oid string, type string, size long, chunks long, compressed_size long, compressed_chunks long, complete boolean, links_indexed boolean"


def chunk_count(size: Column, chunk: int = CHUNK) -> Column:
    """Pieces of so many bytes; 0 for none."""
    return F.floor((size + (chunk - 1)) / chunk).cast("long")


def pieces(objects: DataFrame, form: str = "object", chunk: int = CHUNK) -> DataFrame:
    """(repo_id, form, oid, idx, bytes) of objects (repo_id, oid, bytes); an empty or null one has no piece."""
    size = F.octet_length("bytes")
    cut = objects.where(size > 0).select(*KEY, "bytes", F.explode(F.sequence(F.lit(0), (chunk_count(size, chunk) - 1).cast("int"))).alias("idx"))
    return cut.select("repo_id", F.lit(form).alias("form"), "oid", "idx", F.substr("bytes", F.col("idx") * chunk + 1, F.lit(chunk)).alias("bytes"))


def read_whole(requests: DataFrame, objects: DataFrame, found: DataFrame) -> DataFrame:
    """requests (repo_id, oid, type) with ``bytes``, or a ``fault``: not-found (not stored or not complete), wrong-type,
    missing-chunk, over-run, under-run. found are pieces of the form to read; a null type asks for none. One join reads all requests."""
    stored = objects.where("complete").select(*KEY, F.col("type").alias("__type"), F.col("size").alias("__size"), F.col("chunks").alias("__chunks"))
    joined = found.join(requests.select(*KEY).distinct(), KEY, "left_semi").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("idx", "bytes"))).alias("__pieces"))
    rows = requests.join(stored, KEY, "left").join(joined, KEY, "left")
    listed = F.coalesce("__pieces", F.array().cast("array<struct<idx:int,bytes:binary>>"))
    whole = F.aggregate(F.transform(listed, lambda p: p["bytes"]), F.lit("").cast("binary"), lambda a, b: F.concat(a, b))
    gap = F.exists(F.transform(listed, lambda p, i: p["idx"] != i), lambda x: x) | (F.size(listed) < F.col("__chunks"))
    rows = rows.withColumn("__bytes", whole)
    size = F.octet_length("__bytes")
    fault = (F.when(F.col("__type").isNull(), "not-found").when(F.col("type") != F.col("__type"), "wrong-type")
             .when(gap, "missing-chunk").when(size > F.col("__size"), "over-run").when(size < F.col("__size"), "under-run"))
    return rows.select(*requests.columns, fault.alias("fault"), F.when(fault.isNull(), F.col("__bytes")).alias("bytes"))


def publish(batch: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, objects, links) when batch (repo_id, oid, type, bytes, pos) is written.

    An object that is stored complete is ``kept``; one that is not stored, or was left incomplete, is ``written``; of equal
    ids in a batch the least pos counts and the others are kept. links are those of the written objects, whose
    links_indexed says whether they could be parsed.
    """
    state = objects.select(*KEY, F.col("complete").alias("__complete"))
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("pos"))
    rows = batch.withColumn("__nth", nth).join(state, KEY, "left")
    written = (F.col("__nth") == 1) & ~F.coalesce("__complete", F.lit(False))
    rows = rows.withColumn("outcome", F.when(written, "written").otherwise("kept"))
    new = rows.where("outcome = 'written'").select(*KEY, "type", "bytes")
    named = object_links(new)
    bad = named.where("fault IS NOT NULL").select("repo_id", F.col("source").alias("oid"), F.lit(False).alias("__indexed"))
    packed = new.withColumn("__packed", F.octet_length(deflated("bytes")).cast("long")).join(bad, KEY, "left")
    size = F.octet_length("bytes").cast("long")
    fresh = packed.select(*KEY, "type", size.alias("size"), chunk_count(size).alias("chunks"), F.col("__packed").alias("compressed_size"), chunk_count(F.col("__packed")).alias("compressed_chunks"), F.lit(True).alias("complete"), F.coalesce("__indexed", F.lit(True)).alias("links_indexed"))
    kept = objects.join(new.select(*KEY), KEY, "left_anti")
    return rows.select(*KEY, "pos", "outcome"), kept.unionByName(fresh), named.where("fault IS NULL").drop("fault")


def reclaim(gone: DataFrame, objects: DataFrame, deltas: DataFrame, links: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(totals, objects, deltas, links, pieces) when gone (repo_id, oid) are removed with every form of theirs.

    totals has objects, chunks and bytes of each repository over the four forms: whole and delta, plain and compressed. What
    is not stored gives nothing, so a repeated reclaim changes nothing.
    """
    dead = gone.select(*KEY).distinct()
    rows = objects.join(dead, KEY, "left_semi").join(deltas.select(*KEY, *(F.col(c).alias(f"d_{c}") for c in ("chunks", "size", "compressed_chunks", "compressed_size"))), KEY, "left")
    added = lambda *names: reduce(lambda a, b: a + b, (F.coalesce(F.col(n), F.lit(0)) for n in names))
    totals = rows.groupBy("repo_id").agg(F.count("*").alias("objects"), F.sum(added("chunks", "compressed_chunks", "d_chunks", "d_compressed_chunks")).alias("chunks"), F.sum(added("size", "compressed_size", "d_size", "d_compressed_size")).alias("bytes"))
    by_source = dead.withColumnRenamed("oid", "source")
    return totals, objects.join(dead, KEY, "left_anti"), deltas.join(dead, KEY, "left_anti"), links.join(by_source, ["repo_id", "source"], "left_anti"), found.join(dead, KEY, "left_anti")


def backfill_links(objects: DataFrame, bodies: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, links) when complete objects without indexed links are parsed from bodies (repo_id, oid, bytes).

    Their links replace older ones; one that has no body or cannot be parsed stays as it is."""
    todo = objects.where("complete AND NOT links_indexed").select(*KEY, "type").join(bodies.select(*KEY, "bytes"), KEY)
    named = object_links(todo)
    done = todo.select(*KEY).join(named.where("fault IS NOT NULL").select("repo_id", F.col("source").alias("oid")), KEY, "left_anti").withColumn("__done", F.lit(True))
    after = objects.join(done, KEY, "left").withColumn("links_indexed", F.col("links_indexed") | F.coalesce("__done", F.lit(False))).drop("__done")
    old = links.join(done.select("repo_id", F.col("oid").alias("source")), ["repo_id", "source"], "left_anti")
    return after, old.unionByName(named.where("fault IS NULL").select(*links.columns))


def install_deltas(new: DataFrame, deltas: DataFrame) -> DataFrame:
    """deltas with those of new (the same columns and pos) whose object has none; of equal ids the least pos counts."""
    own = Window.partitionBy(*KEY).orderBy("pos")
    first = new.withColumn("__nth", F.row_number().over(own)).where("__nth = 1").drop("__nth", "pos")
    return deltas.unionByName(first.join(deltas.select(*KEY), KEY, "left_anti"))


def ensure_compressed(objects: DataFrame, bodies: DataFrame) -> DataFrame:
    """objects whose compressed_size and compressed_chunks are filled in where null, by deflating bodies (repo_id, oid, bytes); only those are read."""
    todo = objects.where("complete AND compressed_size IS NULL").select(*KEY).join(bodies.select(*KEY, "bytes"), KEY)
    made = todo.select(*KEY, F.octet_length(deflated("bytes")).cast("long").alias("__size"))
    rows = objects.join(made, KEY, "left")
    return rows.withColumn("compressed_chunks", F.coalesce("compressed_chunks", chunk_count(F.col("__size")))).withColumn("compressed_size", F.coalesce("compressed_size", "__size")).drop("__size")


def metadata(requested: DataFrame, objects: DataFrame, deltas: DataFrame) -> DataFrame:
    """requested (repo_id, oid) that are stored complete, with type, size, chunks and, of those held as a delta too, its base and size."""
    held = deltas.select(*KEY, "base", F.col("size").alias("delta_size"))
    return requested.select(*KEY).distinct().join(objects.where("complete").select(*KEY, "type", "size", "chunks"), KEY).join(held, KEY, "left")


def delta_bases(objects: DataFrame, deltas: DataFrame) -> DataFrame:
    """(repo_id, oid, base) of the deltas of complete objects."""
    return deltas.select(*KEY, "base").join(objects.where("complete").select(*KEY), KEY)
