import random

from hashgrove.llm import mixing, ngram_join, secrets

PAIR = "doc_id long, text string"


def test_pair_bridges_crowded_families_of_differing_main_components(spark):
    """x and y link, but on half of their shared prefix shingles x's family is the largest component, on the others y's."""
    rows = []
    for s in range(6):
        w = [f"w{s}q{i}" for i in range(118)]
        texts = [w[:104], w[14:]] + [[f"f{s}q{j}", *w[:93]] for j in range(70)] + [[*w[25:], f"g{s}q{j}"] for j in range(70)]
        rows += [(1000 * s + i, " ".join(t)) for i, t in enumerate(texts)]
    random.Random(3).shuffle(rows)
    got = {r.doc_id: r.component_id for r in ngram_join.digest(spark.createDataFrame(rows, PAIR).repartition(5)).collect()}
    assert got == {d: d // 1000 * 1000 for d, _ in rows}


def test_long_secrets_are_whole(spark):
    r, alnum = random.Random(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    head = "".join(r.choice(alnum) for _ in range(200))
    keys = [head + "".join(r.choice(alnum) for _ in range(n - 200)) for n in (201, 5000, 5000)]
    rows = [(2 * i + j, f"set {before}{key}{after} now") for i, key in enumerate(keys) for j, (before, after) in enumerate((("token = \"", "\""), ("auth ", "")))]
    got = {(x.doc_id, x.start, x.end, x.secret) for x in secrets.scan(spark.createDataFrame(rows, PAIR)).collect()}
    assert got == {(d, t.index(keys[d // 2]), t.index(keys[d // 2]) + len(keys[d // 2]), keys[d // 2]) for d, t in rows}
    assert len({x.secret_sha256 for x in secrets.digest(spark.createDataFrame([(*x, None) for x in rows], PAIR + ", source string")).collect()}) == 3


def test_stages_keep_rows_of_null_ids(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    base = " ".join(f"w{i}" for i in range(60))
    near = [f"{base} end{i}" for i in range(4)]
    rows = [(None, near[0], "s"), (None, near[1], "s"), (7, near[2], "s"), (None, near[3], None), (None, "one text that stands alone here", "s"), (None, "another text that stands alone here", "t"),
            (None, "copies of it are without an id", "t"), (None, "copies of it are without an id", "t"), (None, "no source and no id has this text, which stands apart", None), (None, None, "s"), (None, "", "s"), (3, "", "s")]
    docs = spark.createDataFrame(rows, PAIR + ", source string").repartition(3)
    want = [rows[i] for i in (2, 4, 5, 6, 8, 9, 10, 11)]
    assert Counter(tuple(r) for r in ngram_join.one_of_each(docs).collect()) == Counter(want)
    only = [(None, t, "s") for t in near]
    assert [r.text in near for r in ngram_join.one_of_each(spark.createDataFrame(only, docs.schema)).collect()] == [True]

    taken = mixing.mix_sources(docs, text_hash=True).where("taken > 0").collect()
    copies = {}
    for r in taken:
        key = (r.doc_id, r.source, r.text_hash)
        copies[key] = max(copies.get(key, 0), -(-r.taken // r["size"]))
    hashed = docs.withColumn("h", F.xxhash64("text")).collect()
    expected = Counter((*tuple(r)[:3], copies[r.doc_id, r.source, r.h]) for r in hashed if (r.doc_id, r.source, r.h) in copies)
    got = mixing.sample_mix(docs).select("doc_id", "text", "source", "copies").collect()
    assert Counter(map(tuple, got)) == expected and sum(r.doc_id is None for r in got) > 3
