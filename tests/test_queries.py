"""Every registered archive query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from archivolt import queries

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "labels", "events", "orders", "customer"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df, cols):
    def plain(v):
        if pd.isna(v):
            return None
        return str(v) if isinstance(v, (str, bool, pd.Timestamp)) or not float(v).is_integer() else str(int(v))

    return sorted((tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows(got, cols) == rows(want, cols)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
