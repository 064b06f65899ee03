"""Invariants: partition count does not change results; shares sum to one;
category totals add up; the fan-out mart never has less sales than the
corrected one; a key holding a third of all rows gives the brute-force answer."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, d, make_orders, make_returns, order_row
from chainlens.operators import dashboard as D
from chainlens.operators import marts as MT
from chainlens.operators import metrics as M
from chainlens.plans import warehouse as W
from chainlens.queries import QUERIES
from chainlens.sources import fixtures as FX


@pytest.mark.parametrize("key", ["mart_vendor_performance", "mart_category_performance", "category_performance",
                                 "lead_time_metrics", "inventory_trends", "dim_customers"])
def test_same_result_for_1_and_8_shuffle_partitions(spark, key):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            return sorted((tuple(r) for r in QUERIES[key](spark, SF_SMALL).collect()), key=str)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert run(1) == run(8)


def test_band_shares_sum_to_one(spark):
    t = FX.tables(spark, SF_SMALL)
    r = M.lead_time_metrics(t.orders).first()
    assert r["excellent_pct"] + r["good_pct"] + r["poor_pct"] == pytest.approx(1.0, abs=1e-5)
    f = M.fill_rate_metrics(t.inventory).first()
    assert f["excellent_fill_rate_pct"] + f["good_fill_rate_pct"] + f["poor_fill_rate_pct"] == pytest.approx(1.0, abs=1e-5)


def test_category_sales_add_up_to_total(spark):
    t = FX.tables(spark, SF_SMALL)
    total = D.analytics_summary(t.orders, t.returns, t.people).first()["total_sales"]
    known = D.analytics_summary(t.orders.where("category is not null"), t.returns, t.people).first()["total_sales"]
    by_cat = sum(r["total_sales"] for r in D.category_sales_total(t.orders).collect())
    by_reg = sum(r["total_sales"] for r in D.regional_sales(t.orders).collect())
    assert by_cat == pytest.approx(known) and known < total and by_reg == pytest.approx(total)


def test_faithful_mart_sales_at_least_corrected(spark):
    faithful = {r["category"]: r["total_sales"] for r in QUERIES["mart_vendor_performance"](spark, SF_SMALL).collect()}
    fixed = {r["category"]: r["total_sales"] for r in
             QUERIES["mart_vendor_performance_line_grain"](spark, SF_SMALL).collect()}
    assert faithful.keys() == fixed.keys()
    assert all(faithful[k] >= fixed[k] for k in faithful)


def _skewed(spark):
    """One order and one product hold a third of all lines; the hot order
    also has several returns."""
    rnd = random.Random(3)
    rows = []
    for i in range(900):
        hot = i % 3 == 0
        rows.append(order_row("HOT" if hot else f"O{i}", "2024-01-01", f"2024-01-{1 + rnd.randrange(20):02d}",
                              prod="PHOT" if hot else f"P{i % 17}", cat="C1" if hot else f"C{i % 4}",
                              qty=1 + rnd.randrange(5), sales=float(rnd.randrange(100, 10000)) / 100))
    orders = make_orders(spark, rows)
    rets = [(d("2024-02-01"), "HOT", "C1", "PHOT", None, None)] * 4 + \
           [(d("2024-02-01"), f"O{i}", "C1", f"P{i % 17}", None, None) for i in range(1, 900, 7) if i % 3]
    returns = make_returns(spark, rets).withColumn(
        "return_id", F.concat(F.lit("R"), F.monotonically_increasing_id().cast("string")))
    prods = [(f"P{i}", f"t{i}", 1.0, f"C{i % 4}", "", None) for i in range(17)] + [("PHOT", "hot", 1.0, "C1", "", None)]
    products = spark.createDataFrame(prods, "id string, title string, price double, category string, "
                                            "description string, image string")
    return orders, products, returns


def test_hot_key_mart_equals_brute_force(spark):
    orders, products, returns = _skewed(spark)
    fo, dp, fr = W.fact_orders(orders), W.dim_products(products), W.fact_returns(returns)
    got = {r["category"]: r.asDict() for r in MT.mart_vendor_performance(fo, dp, fr).collect()}
    # brute force: materialise the fan-out join in pandas
    o = fo.toPandas().merge(dp.select("product_id", "category").toPandas(), on="product_id", how="left")
    j = o.merge(fr.select("order_id", "return_id").toPandas(), on="order_id", how="left")
    for cat, g in j.groupby("category"):
        assert got[cat]["total_orders"] == g["order_id"].nunique()
        assert got[cat]["total_returns"] == g["return_id"].nunique()
        assert got[cat]["total_sales"] == pytest.approx(g["sales"].sum(), rel=1e-12)
        assert got[cat]["avg_lead_time"] == pytest.approx(g["lead_time_days"].mean(), abs=1e-6)


def test_hot_key_category_and_returns(spark):
    orders, _, returns = _skewed(spark)
    pdf = orders.toPandas()
    got = {r["category"]: r.asDict() for r in M.category_sales(orders).collect()}
    for cat, g in pdf.groupby("category"):
        assert got[cat]["unique_orders"] == g["order_id"].nunique()
        assert got[cat]["total_items"] == len(g)
    m = M.return_metrics(orders, returns).first()
    assert m["total_returned_orders"] == returns.select("order_id").distinct().count()
    assert isinstance(pd.DataFrame(), pd.DataFrame)


def test_hot_key_other_operators_equal_brute_force(spark):
    from chainlens.operators import dashboard as D2
    orders, products, _ = _skewed(spark)
    people = orders.select("customer_id").distinct().withColumn("customer_name", F.lit("n")) \
        .withColumn("segment", F.lit("s")).withColumn("region", F.lit("r"))
    pdf = orders.toPandas()
    # dimension of customers: one address per customer (latest order line)
    dc = {r["customer_id"]: r["country"] for r in W.dim_customers(people, orders).collect()}
    assert set(dc) == set(pdf["customer_id"])
    # fulfillment mart: distinct orders and customers per (month, category)
    fo, dp = W.fact_orders(orders), W.dim_products(products)
    got = {(str(r["month"]), r["category"]): r.asDict() for r in MT.mart_fulfillment_analytics(fo, dp).collect()}
    j = fo.toPandas().merge(dp.select("product_id", "category").toPandas(), on="product_id", how="left")
    j["month"] = pd.to_datetime(j["order_date"]).dt.to_period("M").dt.start_time.dt.date.astype(str)
    for (m, cat), g in j.groupby(["month", "category"]):
        assert got[(m, cat)]["total_orders"] == g["order_id"].nunique()
        assert got[(m, cat)]["unique_customers"] == g["customer_id"].nunique()
    # low-stock rule with one product holding a third of the snapshots
    inv = spark.createDataFrame(
        [(f"2024-01-{1 + i % 28:02d}", "HOT", "C1", 100 if i % 10 else 5) for i in range(300)]
        + [(f"2024-01-{1 + i % 28:02d}", f"P{i % 7}", "C2", 50) for i in range(600)],
        "d string, product_id string, category string, stock_level bigint").withColumn("date", F.to_date("d"))
    low = D2.low_stock_vs_max(inv).collect()
    assert len(low) == 30 and {r["product_id"] for r in low} == {"HOT"}


def test_small_dimension_stays_broadcast(spark):
    t = FX.tables(spark, SF_SMALL)
    fo, dp = W.fact_orders(t.orders), W.dim_products(t.products)
    for share in (None, 0.01):
        plan = MT.mart_fulfillment_analytics(fo, dp, skew_share=share)._jdf.queryExecution().executedPlan().toString()
        joins = [x for x in plan.split("\n") if "Join" in x and "_dim_pid" in x]
        assert joins and all("BroadcastHashJoin" in x for x in joins), plan


def test_one_product_join_over_the_lines(spark):
    t = FX.tables(spark, SF_SMALL)
    args = (W.fact_orders(t.orders), W.dim_products(t.products), W.fact_returns(t.returns), W.fact_inventory(t.inventory))
    plan = MT.mart_category_performance_line_grain(*args)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join LeftOuter, (product_id" in x for x in plan.split("\n")) <= 2  # lines, and returns


@pytest.fixture(params=["10MB", "-1"])
def broadcast_limit(spark, request):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_marts_with_salted_hot_product_equal_plain(spark, broadcast_limit):
    orders, products, returns = _skewed(spark)
    fo, dp, fr = W.fact_orders(orders), W.dim_products(products), W.fact_returns(returns)
    for fn in (MT.mart_vendor_performance, MT.mart_vendor_performance_line_grain):
        plain = sorted(map(tuple, fn(fo, dp, fr).collect()), key=str)
        salted = sorted(map(tuple, fn(fo, dp, fr, skew_share=0.2).collect()), key=str)
        assert plain == salted
    plain = sorted(map(tuple, MT.mart_fulfillment_analytics(fo, dp).collect()), key=str)
    salted = sorted(map(tuple, MT.mart_fulfillment_analytics(fo, dp, skew_share=0.2).collect()), key=str)
    assert plain == salted
