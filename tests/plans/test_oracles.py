"""Every query with SQL of its own is held against another engine on the same tables."""

import decimal
import numbers

import duckdb
import pandas as pd
import pytest

from tallymill import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return bool(x)
    if isinstance(x, (numbers.Number, decimal.Decimal)):
        f = float(x)
        return None if f != f else round(f, 6) + 0.0
    return str(x)


def rows(df):
    return sorted((tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name in plans.ORACLE_SQL:
        want = duck.execute(plans.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    assert len(got) or name in ("plan_violations", "alert_stream", "pending_alerts")
