"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import os

import duckdb
import pytest

from sparkwake.plans.registry import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def rounded(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = [tuple(rounded(dict(zip(names, r, strict=True))[c]) for c in columns) for r in want.fetchall()]
    got = [tuple(rounded(r[c]) for c in columns) for r in df.collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)
