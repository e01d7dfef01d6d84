import random
from collections import Counter

from hashgrove.llm import mixing


def test_classes_equal_single_claims():
    r = random.Random(6)
    for _ in range(200):
        kinds = [(r.choice((0.0, 1.0, 2.0, 2.5, 7.0)), r.randint(0, 9), r.randint(1, 5)) for _ in range(r.randint(1, 6))]
        kinds = [(w, c, m) for (w, c), m in {(w, c): m for w, c, m in kinds}.items()]
        single = [(w, c, k) for k, (w, c, m) in enumerate(kinds) for _ in range(m)]
        r.shuffle(single)
        seats = r.randint(0, 40)
        want = mixing.apportion([w for w, _, _ in single], seats, [c for _, c, _ in single])
        each, tied, extra = mixing.apportion_classes([w for w, _, _ in kinds], seats, [c for _, c, _ in kinds], [m for _, _, m in kinds])
        got = []
        for _, _, k in single:
            more = k in tied and extra > 0
            extra -= more
            got.append(each[k] + more)
        assert got == want


def test_any_number_of_sources(spark, same, tmp_path):
    r = random.Random(7)
    rows = [(i, " ".join("w" * r.randint(0, 40)), r.choice((None, "", "s0", f"s{r.randint(0, 3000)}"))) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.coalesce(1).write.parquet(f"{tmp_path}/x")
    next((tmp_path / "x").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    same(mixing.digest(df.repartition(7)), mixing.oracle(), str(tmp_path), ["documents"])
    assert len(Counter(s for _, _, s in rows)) > 1000
