"""Every query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from graphspark import catalogue

from paths import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: "null" if x is None or isinstance(x, float) and math.isnan(x) else format(float(x), ".9g") if isinstance(x, float) else str(x)
    return sorted(tuple(plain(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, db, name):
    got = catalogue.queries()[name](spark, SMALL)
    want = db.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    table = want.fetchall()
    floats = {c for c, t in got.dtypes if t == "double"}
    table = [tuple(float(v) if c in floats and v is not None else v for c, v in zip(columns, r)) for r in table]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, table)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    got = catalogue.queries()[name](spark, SMALL)
    assert got.columns and got.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
