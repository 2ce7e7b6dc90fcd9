"""Every query with SQL for DuckDB gives DuckDB's rows."""

import math

import duckdb
import pytest

from strataql.engine import TABLES
from strataql.operators.queries import oracle_sql, queries

QUERIES, ORACLE = queries(), oracle_sql()


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, int | float):
        return round(float(v), 6)
    return v if v is None else str(v)


def rows(table) -> list:
    return sorted(([plain(r[n]) for n in sorted(r)] for r in table), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    got = [r.asDict() for r in QUERIES[name](spark, sf).collect()]
    found = duck.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    assert rows(got) == rows(want)


def test_joins_of_whole_tables(spark, sf):
    orders = {r.o_orderkey for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect()}
    customers = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment").collect()
    got = sorted((r.x, r.y) for r in QUERIES["join_computed_key"](spark, sf).collect())
    assert got == sorted((k, k + 1) for k in orders if k + 1 in orders)
    want = [(a.c_custkey, b.c_custkey) for a in customers for b in customers if a.c_custkey < b.c_custkey and a[1:] == b[1:]]
    assert sorted((r.x, r.y) for r in QUERIES["join_self"](spark, sf).collect()) == sorted(want)
