"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from tidemark.plans.queries import ORACLE, QUERIES

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in ("events", "lineitem", "supplier"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLE:
        assert len(got) > 0
        return
    want = db.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())
