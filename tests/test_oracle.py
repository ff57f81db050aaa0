"""Every query of the library with SQL against DuckDB on the smallest tables."""

import os

import pandas as pd
import pytest

from driftspan.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def rows(frame):
    def cell(v):
        if v is None or pd.isna(v):
            return "-"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"{float(v):.6f}"
        return str(v)

    names = sorted(frame.columns)
    return names, sorted(tuple(cell(v) for v in r) for r in frame[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0
