"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from tidegauge import registry

SF = "/root/testdata/sf0.001"
#: Its SQL takes a reading a day, which the orders have from this size on.
DAILY = {"q_sliding_window": "/root/testdata/sf0.01"}
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    out = {}
    for sf in {SF, *DAILY.values()}:
        out[sf] = duckdb.connect()
        for t in TABLES:
            out[sf].sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return out


def cell(v):
    if isinstance(v, pd.Timestamp):
        return str(v.to_pydatetime())
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.4f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    sf = DAILY.get(name, SF)
    found = registry.queries()[name](spark, sf)
    columns = sorted(found.columns)
    own = sorted(tuple(cell(r[c]) for c in columns) for r in found.collect())
    wanted = con[sf].sql(registry.oracle_sql()[name])
    assert sorted(wanted.columns) == columns
    at = [wanted.columns.index(c) for c in columns]
    assert own == sorted(tuple(cell(r[i]) for i in at) for r in wanted.fetchall())


def test_queries_without_sql_give_rows(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, SF).columns
