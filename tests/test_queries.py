import pytest

from hashgrove.plans.content import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(name, spark, sf, same):
    same(QUERIES[name](spark, sf), ORACLES[name], sf)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_page_walk_visits_every_row_once_in_order(spark, sf):
    from hashgrove.operators.relational import keyset_page
    from hashgrove.plans.registry import repositories

    df = repositories(spark, sf)
    want = [(r.last_push_at or "", r.name) for r in df.collect()]
    seen, after = [], None
    while True:
        page = keyset_page(df, "last_push_at", "name", 60, after=after).collect()
        seen += [(r.last_push_at or "", r.name) for r in page]
        if not page or not page[0].has_next:
            break
        after = seen[-1]
    assert seen == sorted(want)
