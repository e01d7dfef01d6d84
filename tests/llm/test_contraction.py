import random

from hashgrove.llm import ngram_join


def roots(links):
    least = {v: v for ab in links for v in ab}
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return {(v, c) for v, c in least.items()}


def test_stars_take_one_written_round(spark, monkeypatch):
    written, write = [], ngram_join.staged
    monkeypatch.setattr(ngram_join, "staged", lambda df, name: written.append(name) or write(df, name))
    links = [(10 * i, 10 * i + k) for i in range(5) for k in range(1, 6)]
    got = ngram_join.components(spark.createDataFrame(links, "a long, b long"))
    assert {(r.v, r.c) for r in got.collect()} == roots(links) and len(written) == 1


def test_repeated_links_loops_and_random_graphs(spark):
    r = random.Random(5)
    for n, m in ((12, 12), (60, 45), (60, 300)):
        links = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        links = [(a, b) for a, b in links * 2 if a != b]
        df = spark.createDataFrame(links + [(1000, 1000)], "a long, b long")
        got = [(x.v, x.c) for x in ngram_join.components(df).collect()]
        assert len(got) == len(set(got)) and set(got) == roots(links)
        comp = ngram_join.contracted(df)
        more = [(0, n), (n, n + 1)]
        got = {(x.v, x.c) for x in ngram_join.merged(comp, spark.createDataFrame(more, "a long, b long")).collect()}
        assert got == {(v, c) for v, c in roots(links + more) if v != c}


def test_stars_are_told_from_other_edges(spark):
    for edges, star in (([(3, 1), (2, 1), (9, 5)], True), ([(3, 1), (3, 1)], True), ([(3, 2), (2, 1)], False), ([(3, 1), (3, 2)], False)):
        assert ngram_join.stars(spark.createDataFrame(edges, "u long, v long")) == star
