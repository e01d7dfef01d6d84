"""What a fetch is answered before its pack: refused wants, shallow updates, acknowledgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashgrove.functions.codec import pkt_line


def refused(wants: DataFrame, advertised: DataFrame) -> DataFrame:
    """(request, line) of the requests that want what is not advertised, by their first such want; wants are (request, repo_id, pos, oid)."""
    odd = wants.join(advertised.select("repo_id", "oid").distinct(), ["repo_id", "oid"], "left_anti").groupBy("request").agg(F.min_by("oid", "pos").alias("oid"))
    return odd.select("request", pkt_line(F.concat(F.lit("ERR upload-pack: not our ref "), "oid", F.lit("\n"))).alias("line"))


def common(haves: DataFrame, objects: DataFrame) -> DataFrame:
    """haves (request, repo_id, pos, oid) that are stored, complete where objects says so."""
    held = objects.where("complete") if "complete" in objects.columns else objects
    return haves.join(held.select("repo_id", "oid").distinct(), ["repo_id", "oid"], "left_semi")


def acknowledgements(requests: DataFrame, held: DataFrame) -> DataFrame:
    """(request, part, line) of the answer's lines to requests (request, done, detailed), whose common haves are held.

    Until ``done`` a client that asked for details is told every common have, and then NAK; any other is told the last
    one, or NAK. Once done, the last one or NAK stands before the pack.
    """
    last = held.groupBy("request").agg(F.max_by("oid", "pos").alias("oid"), F.max("pos").alias("pos"))
    each = held.join(requests.where("NOT done AND detailed").select("request"), "request", "left_semi")
    each = each.select("request", F.col("pos").cast("long").alias("part"), F.concat(F.lit("ACK "), "oid", F.lit(" common\n")).alias("text"))
    end = requests.join(last, "request", "left")
    text = F.when((~F.col("done") & F.col("detailed")) | F.col("oid").isNull(), "NAK\n").otherwise(F.concat(F.lit("ACK "), "oid", F.lit("\n")))
    ends = end.select("request", (F.coalesce("pos", F.lit(-1)) + 1).cast("long").alias("part"), text.alias("text"))
    return each.unionByName(ends).select("request", "part", pkt_line(F.col("text")).alias("line"))


def shallow_lines(plan: DataFrame) -> DataFrame:
    """(repo_id, part, oid, line) of the shallow, then the unshallow lines of a depth plan; a flush, part 2, ends each repository's."""
    kinds = F.when(F.col("shallow"), F.lit(0)).when(F.col("unshallow"), F.lit(1))
    rows = plan.select("repo_id", kinds.alias("part"), "oid").where("part IS NOT NULL")
    lines = rows.select("repo_id", "part", "oid", pkt_line(F.concat(F.when(F.col("part") == 0, "shallow ").otherwise("unshallow "), "oid", F.lit("\n"))).alias("line"))
    return lines.unionByName(plan.select("repo_id").distinct().select("repo_id", F.lit(2).alias("part"), F.lit("").alias("oid"), F.lit("0000").cast("binary").alias("line")))
