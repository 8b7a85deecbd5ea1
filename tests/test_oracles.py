"""Every query that SQL can express gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from reelspan.plans import registry
from reelspan.plans.fixtures import BASE

registry.load()
DATA = os.environ.get("REELSPAN_DATA", "/root/testdata/sf0.001")


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(float(v), 5) + 0.0 if not isinstance(v, (str, int)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in BASE:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA), duck.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[k]) for k in columns) for r in got.collect()), key=str)
    at = [want.columns.index(k) for k in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() >= 0
