"""Every registered query against its DuckDB SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import armwise.queries as base

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list[tuple]:
    def value(x):
        if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
            return str(list(x))
        return "null" if x is None or pd.isna(x) else repr(float(x)) if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "if" else str(x)

    return sorted(tuple(map(value, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(base.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = base.QUERIES[name](spark, SF).toPandas(), duck.sql(base.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_every_query(spark):
    import __spark_entry__ as e

    assert set(base.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
