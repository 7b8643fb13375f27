"""Every query that has SQL gives the rows of its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from barloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

registry._load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v + 0.0:.6g}"
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry._sql))
def test_equals_sql(name, spark, duck):
    found = registry.queries()[name](spark, SF).toPandas()
    wanted = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", ["opt05_walk_forward", "opt05_walk_forward_summary", "rsh02_03_forward_fill"])
def test_equals_sql_over_more_bars(name, spark):
    """Where the smallest table has too few bars for a fold, or hides where the range of time ends."""
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{sf}/events.parquet'")
    found = rows(registry.queries()[name](spark, sf).toPandas())
    assert found and found == rows(con.sql(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry._queries) - set(registry._sql)))
def test_runs_without_sql(name, spark):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
