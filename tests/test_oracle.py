"""Every registered query against its DuckDB oracle SQL at sf0.01 (exact)."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb
import pytest

from conftest import SF_ORACLE

import __spark_entry__ as E
from chainlens.oracle_sql import oracle_sql
from chainlens.queries import QUERIES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_ORACLE, t + '.parquet')}')")
    return c


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, float) and math.isnan(v):
            return ("nan",)
        if isinstance(v, dt.datetime):
            return v.replace(tzinfo=None)
        return v

    out = [tuple(norm(r[i]) for i in order) for r in rows]
    key = lambda row: tuple((0, "") if v is None else (1, type(v).__name__, v) for v in row)
    return [cols[i] for i in order], sorted(out, key=key)


def test_every_query_has_oracle():
    assert set(QUERIES) == set(oracle_sql())
    assert set(QUERIES) <= set(E.queries()) and set(oracle_sql()) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF_ORACLE)
    s_cols, s_rows = _canon(df.columns, [tuple(r) for r in df.collect()])
    assert s_rows or key == "alerts"  # a key that returns nothing compares nothing
    cur = con.execute(oracle_sql()[key])
    d_cols, d_rows = _canon([x[0] for x in cur.description], [tuple(r) for r in cur.fetchall()])
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows)
    assert s_rows == d_rows


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["category", "total_orders", "avg_lead_time", "avg_order_value", "total_sales",
                          "total_profit", "total_returns", "return_rate"]
