"""Registered queries against their SQL on the smallest given tables, where they are there."""

import os

import pytest

import __spark_entry__ as entry
from gavelflow.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: No SQL: a Unicode form that DuckDB lacks, event-time timers, and reprices that tests hold against one fold.
WITHOUT_SQL = {"clean_text", "stream_close_timers", "stream_reprice"}


def told(x):
    return "" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x)


def test_registry():
    assert set(ORACLE_SQL) <= set(QUERIES) and set(QUERIES) - set(ORACLE_SQL) == WITHOUT_SQL
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    frame, want = entry.queries()[name](spark, SF), db.sql(ORACLE_SQL[name])
    assert sorted(frame.columns) == sorted(want.columns)
    rows = lambda columns, values: sorted(tuple(told(r[columns.index(c)]) for c in sorted(columns)) for r in values)
    assert rows(frame.columns, frame.collect()) == rows(want.columns, want.fetchall())
