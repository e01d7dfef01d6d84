from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same():
    """Compare a DataFrame with DuckDB SQL over the same tables, in any order."""
    import duckdb

    from hashgrove.sources.fixtures import RAW

    def rows(pdf):
        names = sorted(pdf.columns)
        plain = lambda x: int(x) if isinstance(x, float) and x.is_integer() else x  # noqa: E731  # long columns with nulls come as floats
        return names, sorted(repr(tuple(map(plain, r))) for r in pdf[names].astype(object).where(pdf[names].notna(), None).itertuples(index=False, name=None))

    def check(df, sql, where, tables=RAW):
        con = duckdb.connect()
        for t in tables:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
        got, want = rows(df.toPandas()), rows(con.sql(sql).df())
        assert got == want
        return got[1]

    return check
