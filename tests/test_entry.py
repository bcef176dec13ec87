"""Registered queries against their DuckDB counterparts on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def plain(v):
    if v is None or isinstance(v, (str, bool, int)):
        return v
    return round(float(v), 6) if isinstance(v, float) or hasattr(v, "as_tuple") else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    return c


FAST = [k for k in entry.oracle_sql() if k not in {"units_by_dim", "unit_identity", "reason_histogram", "pass_rate_by_source", "event_counts_map"}]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert got == want


def test_entry_and_names(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
