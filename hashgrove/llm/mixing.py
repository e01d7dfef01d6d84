"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashgrove.llm.shared import staged

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), Fraction(3, 2), 2, 17
SHARD_WORDS, MAX_SHARDS, MAX_BLOCK, BLOCKS_OF_LEAST = 500_000, 1 << 16, 1024, 256
WORD = r"[^\x20\x09-\x0D]+"


def divisor_seats(w: np.ndarray, seats: int, cap: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, int]:
    """(seats of each entry, seats left) of Sainte-Laguë where entry i stands for many[i] claimants: as many of the highest
    quotients w/1, w/3, w/5 ... as one divisor deals; the seats left are fewer than the claimants tied for the next quotients. A divisor is found by bisection."""
    seats = int(min(seats, (cap * many)[w > 0].sum()))
    if seats <= 0:
        return np.zeros(len(w), dtype=np.int64), 0
    at = lambda x: np.where(w > 0, np.minimum(cap, np.floor(w * x + 0.5)), 0).astype(np.int64)
    low, high = 0.0, 1.0 / w[w > 0].min()
    while (at(high) * many).sum() < seats:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (at(mid) * many).sum() <= seats else (low, mid)
    n = at(low)
    return n, seats - int((n * many).sum())


def apportion(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Sainte-Laguë: the ``seats`` highest quotients w/1, w/3, w/5 ..., ties to the earlier entry, at most caps[i] each."""
    w, cap = np.asarray(weights, dtype=float), np.asarray(caps, dtype=np.int64)
    n, rest = divisor_seats(w, seats, cap, np.ones(len(w), dtype=np.int64))
    while rest > 0:
        open_ = np.flatnonzero((n < cap) & (w > 0))
        quotient = w[open_] / (2 * n[open_] + 1)
        next_ = open_[np.lexsort((open_, -quotient))][:rest]
        n[next_] += 1
        rest -= len(next_)
    return n.tolist()


def apportion_classes(weights: list[float], seats: int, caps: list[int], many: list[int]) -> tuple[list[int], list[int], int]:
    """apportion() for classes of many[i] equal claimants: (seats of each member, the classes tied for the last seats, how many
    of their members, in order, get one more)."""
    w, cap, m = np.asarray(weights, dtype=float), np.asarray(caps, dtype=np.int64), np.asarray(many, dtype=np.int64)
    n, rest = divisor_seats(w, seats, cap, m)
    while rest > 0:
        open_ = np.flatnonzero((n < cap) & (w > 0))
        quotient = w[open_] / (2 * n[open_] + 1)
        tied = open_[quotient == quotient.max()]
        if m[tied].sum() > rest:
            return n.tolist(), tied.tolist(), rest
        n[tied] += 1
        rest -= int(m[tied].sum())
    return n.tolist(), [], 0


def water_fill(sizes: list[int], weights: list[int], many: list[int], share: Fraction = SHARE, cap: int = CAP) -> list[Fraction]:
    """Targets by weight that sum to share of all sizes, none above cap times its size; the excess is reshared by weight.

    Entry i stands for many[i] sources of that size and weight; each of them has its target."""
    left, target, active = share * sum(s * m for s, m in zip(sizes, many)), [Fraction(0)] * len(sizes), list(range(len(sizes)))
    while active:
        total = sum(weights[i] * many[i] for i in active)
        over = [i for i in active if left * weights[i] > cap * sizes[i] * total]
        if not over:
            for i in active:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = Fraction(cap * sizes[i])
        left -= sum(target[i] * many[i] for i in over)
        gone = set(over)
        active = [i for i in active if i not in gone]
    return target


def numbered(sources: DataFrame) -> DataFrame:
    """sources with ``place``: 0, 1, 2 ... by code point, null last. Ranges are sorted apart; one count a range reaches the driver."""
    rows = staged(sources.orderBy(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "mix-sources")
    before, table = 0, []
    for r in sorted(rows.groupBy("part").count().collect()):
        table.append((r.part, before))
        before += r["count"]
    offsets = rows.sparkSession.createDataFrame(table, "part int, before long")
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    return rows.withColumn("own", own).join(F.broadcast(offsets), "part").select("source", "size", (F.col("own") + F.col("before")).alias("place"))


def source_targets(sized: DataFrame) -> tuple[DataFrame, int, int]:
    """(sources with source_size, target and blocks, words of a block, all words) of sized (source, size).

    A source's target and blocks depend on its size and weight alone, so the driver sees one row for each pair of them: fewer
    than 3 * sqrt(2 * words), as sizes that differ add up, however many sources there are. The last seats of equal quotients go by place.
    """
    ranked = numbered(sized.groupBy("source").agg(F.sum("size").alias("size")))
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")))
    rows = sorted((r["size"], r.w, r.n) for r in ranked.groupBy("size", "w").agg(F.count("*").alias("n")).collect())
    sizes, weights, many = (list(c) for c in zip(*rows)) if rows else ([], [], [])
    exact = water_fill(sizes, weights, many)
    targets = [float(t) for t in exact]
    block = int(max(1, min(MAX_BLOCK, min((t for t in targets if t > 0), default=1) // BLOCKS_OF_LEAST)))
    seats, tied, extra = apportion_classes(targets, round(float(sum(t * m for t, m in zip(exact, many))) / block), [CAP * s // block for s in sizes], many)
    spark = sized.sparkSession
    classes = spark.createDataFrame([(s, w, t, n, i in set(tied)) for i, (s, w, t, n) in enumerate(zip(sizes, weights, targets, seats))], "size long, w int, target double, blocks long, tied boolean")
    sources = ranked.join(classes, ["size", "w"])
    if extra:
        more = sources.where("tied").orderBy("place").limit(extra).select("place", F.lit(1).alias("more"))
        sources = sources.join(more, "place", "left").withColumn("blocks", F.col("blocks") + F.coalesce("more", F.lit(0)))
    sources = sources.select(key_of(F.col("source")).alias("skey"), F.col("size").alias("source_size"), "target", "blocks")
    return staged(sources, "mix-targets"), block, sum(s * m for s, m in zip(sizes, many))


def key_of(source: Column) -> Column:
    """A key that null sources share: ``n``, others ``s`` and their name."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def mix_sources(docs: DataFrame, seed: int = SEED, text_hash: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of docs (doc_id, source, text).

    Sizes are counted in words; a null or empty text has size 0 and takes 0. Blocks go to sources, then to the shards of a
    source, by Sainte-Laguë; in a shard, documents stand in seeded order, the whole order is taken as often as
    its quota covers, and the leading blocks once more. A hot source has as many shards as any, so no task
    holds it whole; there may be any number of sources. Reruns agree; repeated rows count each; an empty table gives no rows. With
    ``text_hash``, a column of that name tells texts of one id, null ones too, apart.
    """
    named = [F.xxhash64("text").alias("text_hash")] if text_hash else []
    sized = staged(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *named), "mix-sizes")
    per_source, block, total = source_targets(sized)
    shards = max(1, min(MAX_SHARDS, -(-total // SHARD_WORDS)))

    dealt = sized.withColumns({"skey": key_of(F.col("source")), "h": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))})
    dealt = dealt.withColumn("shard", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % shards)
    def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        words = pdf.words.tolist()
        given = apportion(words, int(pdf.blocks.iloc[0]), [-(-CAP * w // block) for w in words])
        return pdf.assign(quota=[min(n * block, CAP * w) for n, w in zip(given, words)])[["skey", "shard", "words", "quota"]]

    cells = dealt.groupBy("skey", "shard").agg(F.sum("size").alias("words")).join(per_source, "skey")
    quota = staged(cells.groupBy("skey").applyInPandas(quotas, "skey string, shard long, words long, quota long"), "mix-quotas")
    order = Window.partitionBy("skey", "shard").orderBy("h", "size", *["text_hash"] * text_hash).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0)))
    times = F.expr("CASE WHEN words > 0 THEN quota DIV words ELSE 0 END")
    more = F.expr("CASE WHEN words > 0 THEN quota % words ELSE 0 END")
    return placed.join(quota, ["skey", "shard"]).join(per_source, "skey").select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * times + F.least(F.greatest(more - F.col("start"), F.lit(0)), F.col("size"))).cast("long").alias("taken"),
        *["text_hash"] * text_hash,
    )


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op7."""
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def sample_mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with a column ``copies``: how often the mix repeats each document's words, rounded up; rows that it leaves out go.

    Rows of one doc_id, source and text, null ones too, share the first one's copies.
    """
    key = {"__d": F.col("doc_id"), "__s": F.col("source"), "__t": F.col("text_hash")}
    mix = mix_sources(docs, seed, text_hash=True).where("taken > 0").groupBy(*[c.alias(n) for n, c in key.items()]).agg(F.max(F.expr("CAST(ceil(taken / size) AS INT)")).alias("copies"))
    rows = docs.drop("copies").withColumn("__h", F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(mix["__d"]) & rows["source"].eqNullSafe(mix["__s"]) & (rows["__h"] == mix["__t"])
    return rows.join(mix, same).drop(*key, "__h")


def oracle(seed: int = SEED) -> str:
    """DuckDB SQL of op7: quotients are enumerated and ranked."""
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS ssize FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS ord FROM t),
w AS (SELECT *, [3, 1, 2][((ord - 1) % 3 + 1)::INT] AS wt, 1.5 * sum(ssize) OVER () AS total FROM o),
f AS (SELECT *, coalesce(sum(2 * ssize) OVER (ORDER BY 2 * ssize / wt, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(wt) OVER (ORDER BY 2 * ssize / wt DESC, ord DESC) AS above FROM w),
l AS (SELECT min((total - below)::DOUBLE / above) FILTER ((total - below) * wt <= 2 * ssize * above) AS lam FROM f),
lm AS (SELECT f.source, f.ord, f.ssize, f.wt, CASE WHEN (total - below) * wt > 2 * ssize * above THEN 2.0 * ssize ELSE NULL END AS capped, total FROM f),
g AS (SELECT *, (total - coalesce(sum(capped) OVER (), 0)) AS rest, sum(wt) FILTER (capped IS NULL) OVER () AS wrest FROM lm),
x AS (SELECT source, ord, ssize, coalesce(capped, (rest * wt)::DOUBLE / wrest)::DOUBLE AS target FROM g),
b AS (SELECT greatest(1, least({MAX_BLOCK}, floor(min(target) FILTER (target > 0) / {BLOCKS_OF_LEAST})))::BIGINT AS block, sum(target) AS tt, greatest(1, ceil(sum(ssize) / {SHARD_WORDS}.0))::BIGINT AS shards FROM x),
q AS (SELECT source, ord, target / (2 * k - 1) AS quotient FROM (SELECT x.*, unnest(range(1, 2 * ssize // block + 1)) AS k FROM x, b WHERE target > 0)),
r AS (SELECT source, ord, count(*) AS blocks FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, ord) AS rn FROM q) WHERE rn <= (SELECT round_even(tt / block, 0) FROM b) GROUP BY source, ord),
dd AS (SELECT doc_id, source, size, md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM d),
e AS (SELECT dd.*, ('0x' || substr(h, 1, 8))::BIGINT % (SELECT shards FROM b) AS shard FROM dd),
c AS (SELECT e.source, shard, sum(size)::BIGINT AS words FROM e GROUP BY ALL),
cq AS (SELECT c.source, shard, words, blocks, unnest(range(1, (2 * words + block - 1) // block + 1)) AS k FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source, b),
cr AS (SELECT source, shard, words, row_number() OVER (PARTITION BY source ORDER BY words::DOUBLE / (2 * k - 1) DESC, shard) AS rn, blocks FROM cq),
cg AS (SELECT source, shard, count(*) FILTER (rn <= blocks) AS n FROM cr GROUP BY ALL),
p AS (SELECT e.*, c.words, least(coalesce(n, 0) * block, 2 * words)::BIGINT AS quota, coalesce(sum(size) OVER (PARTITION BY e.source, e.shard ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM e JOIN c ON e.source IS NOT DISTINCT FROM c.source AND e.shard = c.shard LEFT JOIN cg ON e.source IS NOT DISTINCT FROM cg.source AND e.shard = cg.shard, b)
SELECT doc_id, size, ssize AS source_size, target,
  (CASE WHEN words > 0 THEN size * (quota // words) + least(greatest(quota % words - start, 0), size) ELSE 0 END)::BIGINT AS taken
FROM p JOIN x ON p.source IS NOT DISTINCT FROM x.source"""
