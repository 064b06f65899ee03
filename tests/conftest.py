from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from chainlens.session import build_session
    wh = tempfile.mkdtemp(prefix="chainlens-test-wh-")
    s = build_session(master="local[*]", shuffle_partitions=8, app_name="chainlens-tests", driver_memory="4g",
                      extra={"spark.sql.warehouse.dir": wh,
                             # tiny fixtures: keep several write tasks instead of one
                             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"})
    if not s.conf.get("spark.checkpoint.dir", None):
        ck = tempfile.mkdtemp(prefix="chainlens-test-ckpt-")
        s.sparkContext.setCheckpointDir(ck)
        s.conf.set("spark.checkpoint.dir", ck)
    yield s
    s.stop()


@pytest.fixture()
def tmp_root(spark):
    from chainlens.session import scratch_path
    return scratch_path(spark, "test")


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


ORDERS_DDL = ("order_id string, order_date date, ship_date date, customer_id string, product_id string, "
              "category string, quantity bigint, sales double, profit double, discount double, "
              "country string, state string, region string")

INVENTORY_DDL = ("date date, product_id string, product_name string, category string, stock_level bigint, "
                 "daily_demand bigint, restock_amount bigint, restocked boolean, price double, "
                 "original_price double, price_change_pct double, days_of_inventory double, "
                 "stockout_risk boolean, annualized_turnover double, fill_rate double")

RETURNS_DDL = "return_date date, order_id string, customer_id string, product_id string, category string, region string"


def make_orders(spark, rows, enrich=True):
    from chainlens.operators.transforms import enrich_orders, normalise_doubles
    df = normalise_doubles(spark.createDataFrame(rows, ORDERS_DDL))
    return enrich_orders(df) if enrich else df


def make_inventory(spark, rows):
    from chainlens.operators.transforms import normalise_doubles
    return normalise_doubles(spark.createDataFrame(rows, INVENTORY_DDL))


def make_returns(spark, rows):
    return spark.createDataFrame(rows, RETURNS_DDL)


def order_row(oid, od, sd, cust="C1", prod="P1", cat="Furniture", qty=1, sales=10.0, profit=1.0,
              disc=0.0, country="US", state="CA", region="West"):
    return (oid, d(od) if od else None, d(sd) if sd else None, cust, prod, cat, qty, sales, profit, disc,
            country, state, region)


def inv_row(day, prod, cat="Furniture", stock=10, demand=5, fill=1.0, risk=False, turnover=2.0, doi=None):
    return (d(day), prod, f"name {prod}", cat, stock, demand, 0, False, 9.99, 9.99, 0.0,
            doi, risk, turnover, fill)
