"""Every query of the catalogue that has SQL gives the same rows as DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from echolake import queries

DATA = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def _text(v) -> str:
    return "%.9g" % v if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted(tuple(_text(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    wanted = sorted(tuple(_text(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert found == wanted


def test_queries_without_sql_have_rows(spark):
    for name in sorted(set(queries.QUERIES) - set(queries.SQL)):
        assert queries.QUERIES[name](spark, DATA).count() > 0, name
