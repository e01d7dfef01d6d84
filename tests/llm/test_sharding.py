import random
from collections import Counter

import pytest

from hashgrove.llm import sharding
from hashgrove.llm.shared import documents, staged

PAIR = "doc_id long, text string"


def brute(rows, shards):
    """Recursive cuts of (dims, size, row, seq) rows in plain Python: the shard of each (row, seq)."""
    out, wide = {}, [max(r[0][d] for r in rows) - min(r[0][d] for r in rows) or 1 for d in (0, 1)]

    def split(rows, first, count):
        if count == 1 or not rows:
            out.update({r[2:]: first for r in rows})
            return
        dim = max((0, 1), key=lambda d: (max(r[0][d] for r in rows) - min(r[0][d] for r in rows)) / wide[d])
        rows = sorted(rows, key=lambda r: (r[0][dim], *r[2:]))
        need, passed, k = max(1, sum(r[1] for r in rows) * (count // 2) // count), 0, 0
        while passed + rows[k][1] < need:
            passed += rows[k][1]
            k += 1
        k += 2 * (need - passed) > rows[k][1]
        split(rows[:k], first, count // 2)
        split(rows[k:], first + count // 2, count - count // 2)

    split(rows, 0, shards)
    return out


def texts(r, n):
    return [(r.choice((None, i, i)), r.choice(("", "x" * r.randint(1, 90), "ä" * r.randint(0, 40) + "b" * r.randint(0, 40), "one text"))) for i in range(n)]


@pytest.mark.parametrize("few", [1, 1 << 14])
def test_tree_equals_brute_force(few, spark, sf, monkeypatch):
    monkeypatch.setattr(sharding, "FEW_ROWS", few)
    for docs, shards in ((documents(spark, sf), 24), (spark.createDataFrame(texts(random.Random(few), 300), PAIR), 7), (spark.createDataFrame([(None, "a")] * 50 + [(1, "b")] * 9, PAIR), 5)):
        base = staged(sharding.points(docs), "points")
        rows = [((r.log_size, r.multi_byte), r["size"], r["__row"], r["__seq"]) for r in base.collect()]
        got = {(r["__row"], r["__seq"]): r.node for r in sharding.kd_tree(base, sharding.DIMS, shards, tolerance=0.0).collect()}
        assert got == brute(rows, shards)


def test_equal_rows_spread_evenly(spark):
    for rows in ([(None, "same text here")] * 2400, [(5, "same text here")] * 2400):
        pdf = sharding.digest(spark.createDataFrame(rows, PAIR).repartition(6)).toPandas()
        assert set(Counter(pdf["shard"]).values()) == {100} and len(set(pdf["shard"])) == 24
        assert all(sorted(g.slot) == list(range(100)) for _, g in pdf.groupby("shard"))


def test_other_rows(spark):
    """Nulls, empty texts, few rows, clashing columns, no rows."""
    rows = [(None, None), (1, None), (2, ""), (3, "x" * 100_000), (3, "x" * 100_000)]
    docs = spark.createDataFrame(rows, PAIR).selectExpr("*", "1 AS node", "2 AS size", "3 AS shard", "4 AS __row", "5 AS slot")
    pdf = sharding.shard_documents(docs, shards=24).toPandas()
    assert sorted(pdf["size"]) == [8, 8, 8, 100_008, 100_008] and pdf["shard"].between(0, 23).all()
    assert pdf[pdf["size"] > 8]["shard"].nunique() == 2
    assert sharding.shard_documents(docs.limit(0), shards=24).count() == 0
    assert sharding.shard_documents(docs, target_bytes=100_000).toPandas()["shard"].nunique() > 1


def test_targets_of_bytes(spark, sf):
    pdf = sharding.shard_documents(documents(spark, sf), target_bytes=60_000).toPandas()
    n = -(-pdf["size"].sum() // 60_000)
    assert set(pdf["shard"]) <= set(range(n))
