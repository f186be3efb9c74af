"""Every query with SQL gives the SQL's rows on the smallest test data."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda n: names[n])
    return Counter(repr([v[n] for n in order]) for v in values)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("p") or not n[1].isdigit()))
def test_query(spark, tables, name):
    df = entry.queries()[name](spark, DATA)
    want = tables.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


def test_all_core_queries_have_sql():
    assert {n for n in entry.queries() if not (n[0] == "p" and n[1].isdigit())} <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
