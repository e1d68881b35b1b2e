"""Every query with SQL against another engine."""

import math

import duckdb
import pytest

from lakeloom.plans import workloads
from lakeloom.session import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(workloads.SQL))
def test_query(spark, engine, name):
    df = workloads.QUERIES[name](spark, FOLDER)
    other = engine.sql(workloads.SQL[name])
    assert sorted(df.columns) == sorted(other.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(list(other.columns), other.fetchall())
