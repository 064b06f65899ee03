"""Edge cases on hand-made frames: NULL / NaN, boundaries, ties, empty input,
fan-out, missing optional columns."""

from __future__ import annotations

import math
import statistics

import pytest
from pyspark.sql import functions as F

from conftest import d, inv_row, make_inventory, make_orders, make_returns, order_row
from chainlens.functions import columns as C
from chainlens.operators import dashboard as D
from chainlens.operators import marts as MT
from chainlens.operators import metrics as M
from chainlens.operators import quality as Q
from chainlens.plans import warehouse as W


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0].asDict()


@pytest.fixture()
def lead_orders(spark):
    # lead times 0, 3, 7, 14, 30 (valid), 31 and -1 (invalid), NULL ship date (invalid)
    rows = [order_row(f"O{i}", "2024-01-01", s) for i, s in enumerate(
        ["2024-01-01", "2024-01-04", "2024-01-08", "2024-01-15", "2024-01-31", "2024-02-01", "2023-12-31", None])]
    return make_orders(spark, rows)


def test_lead_time_family_boundaries(lead_orders):
    r = one(M.lead_time_metrics(lead_orders))
    vals = [0, 3, 7, 14, 30]
    assert r["total_orders"] == 5
    assert r["invalid_lead_times"] == 3
    assert r["mean_lead_time"] == pytest.approx(10.8)
    assert r["median_lead_time"] == 7.0
    assert r["std_lead_time"] == round(statistics.stdev(vals), 6)
    assert r["min_lead_time"] == 0.0 and r["max_lead_time"] == 30.0
    assert r["lead_time_95th_percentile"] == pytest.approx(26.8)
    assert (r["excellent_pct"], r["good_pct"], r["poor_pct"]) == (0.4, 0.2, 0.4)


def test_cycle_time_matches_lead_time(lead_orders):
    lt, ct = one(M.lead_time_metrics(lead_orders)), one(M.order_cycle_time_metrics(lead_orders))
    assert ct["mean_cycle_time"] == lt["mean_lead_time"]
    assert ct["cycle_time_95th_percentile"] == lt["lead_time_95th_percentile"]
    assert ct["total_orders"] == 5


def test_single_valid_row_std_is_null(spark):
    o = make_orders(spark, [order_row("A", "2024-01-01", "2024-01-05"), order_row("B", "2024-01-01", None)])
    r = one(M.lead_time_metrics(o))
    assert r["std_lead_time"] is None and r["total_orders"] == 1 and r["invalid_lead_times"] == 1


def test_empty_input_gives_no_rows(spark):
    o = make_orders(spark, [])
    assert M.lead_time_metrics(o).count() == 0
    assert M.order_cycle_time_metrics(o).count() == 0
    assert M.return_metrics(o, make_returns(spark, [])).count() == 0
    inv = make_inventory(spark, [])
    assert M.fill_rate_metrics(inv).count() == 0
    assert M.stockout_risk_metrics(inv).count() == 0
    assert M.inventory_turnover_metrics(inv).count() == 0


def test_fill_rate_nan_null_and_band_edges(spark):
    fills = [1.0, 0.95, 0.85, 0.84, float("nan"), None]
    inv = make_inventory(spark, [inv_row("2024-01-01", f"P{i}", fill=f) for i, f in enumerate(fills)])
    r = one(M.fill_rate_metrics(inv))
    assert r["mean_fill_rate"] == pytest.approx(0.91)
    assert (r["excellent_fill_rate_pct"], r["good_fill_rate_pct"], r["poor_fill_rate_pct"]) == (0.5, 0.25, 0.25)


def test_stockout_counts_rows(spark):
    inv = make_inventory(spark, [inv_row("2024-01-01", "P1", risk=True), inv_row("2024-01-02", "P1", risk=True),
                                 inv_row("2024-01-01", "P2", risk=False)])
    r = one(M.stockout_risk_metrics(inv))
    assert (r["products_at_risk"], r["total_products"]) == (2, 3)
    assert r["risk_percentage"] == round(2 / 3, 6)


def test_days_of_inventory_skips_zero_stock_and_demand(spark):
    inv = make_inventory(spark, [inv_row("2024-01-01", "P1", stock=10, demand=5),
                                 inv_row("2024-01-01", "P2", stock=0, demand=5),
                                 inv_row("2024-01-01", "P3", stock=10, demand=0),
                                 inv_row("2024-01-01", "P4", stock=30, demand=5)])
    r = one(M.days_of_inventory_metrics(inv))
    assert r["mean_days_of_inventory"] == 4.0 and r["median_days_of_inventory"] == 4.0


def test_category_breakdown_null_category_and_ties(spark):
    rows = [order_row("A", "2024-01-01", "2024-01-03", cat="Beta", sales=10.0),
            order_row("B", "2024-01-01", "2024-01-02", cat="Alpha", sales=4.0),
            order_row("C", "2024-01-01", "2024-01-02", cat="Alpha", sales=6.0),
            order_row("C", "2024-01-01", "2024-01-05", cat=None, sales=100.0)]
    o = make_orders(spark, rows)
    cats = {r["category"]: r.asDict() for r in M.category_performance(o).collect()}
    assert set(cats) == {"Alpha", "Beta"}
    assert cats["Alpha"]["total_sales"] == 10.0 and cats["Alpha"]["unique_orders"] == 2
    assert cats["Alpha"]["avg_sale"] == 5.0
    top = one(M.top_sales_category(o))
    assert top["category"] == "Alpha"  # tie at 10.0 -> first category in ascending order
    best = one(M.best_lead_time_category(o))
    assert best["category"] == "Alpha" and best["avg_lead_time"] == 1.0


def test_category_rounding_half_even(spark):
    # mean 0.125 rounds to 0.12 half-to-even
    o = make_orders(spark, [order_row("A", "2024-01-01", "2024-01-01", sales=0.1),
                            order_row("B", "2024-01-01", "2024-01-01", sales=0.15)])
    assert one(M.category_sales(o))["avg_sale"] == 0.12


def test_return_metrics_counts_null_order_once(spark):
    o = make_orders(spark, [order_row(f"O{i}", "2024-01-01", "2024-01-02") for i in range(4)])
    r = make_returns(spark, [(d("2024-01-01"), "O1", "C1", "P1", "Furniture", "West"),
                             (d("2024-01-01"), "O1", "C1", "P1", "Furniture", "West"),
                             (d("2024-01-01"), None, "C1", "P1", None, None)])
    m = one(M.return_metrics(o, r))
    assert (m["total_orders"], m["total_returned_orders"], m["total_return_items"]) == (4, 2, 3)
    assert m["return_rate"] == 0.5
    by_cat = M.returns_by(r, "category").collect()
    assert [(x["category"], x["return_count"]) for x in by_cat] == [("Furniture", 2)]


def test_expected_returns_default_rate(spark):
    o = make_orders(spark, [order_row("A", "2024-01-01", "2024-01-02", cat="Furniture"),
                            order_row("B", "2024-01-01", "2024-01-02", cat="Unknown Cat"),
                            order_row("C", "2024-01-01", "2024-01-02", cat="Unknown Cat")])
    got = {r["category"]: r.asDict() for r in M.expected_returns_by_category(o).collect()}
    assert got["Furniture"]["expected_returns"] == 0.15
    assert got["Unknown Cat"]["expected_returns"] == 0.1
    assert got["Unknown Cat"]["expected_return_rate"] == 0.05


def test_stratified_sample_is_partition_independent(spark):
    o = make_orders(spark, [order_row(f"O{i}", "2024-01-01", "2024-01-02", cat="Furniture") for i in range(400)])
    o = o.withColumn("supplier_id", F.lit("S")).withColumn("line_number", F.lit(1))
    a = {tuple(r) for r in M.stratified_return_sample(o.repartition(1), seed=7).collect()}
    b = {tuple(r) for r in M.stratified_return_sample(o.repartition(7), seed=7).collect()}
    assert "return_reason" not in M.stratified_return_sample(o).columns
    assert a == b and 20 < len(a) < 110  # about 15 % of 400


def test_fanout_mart_vs_corrected(spark):
    orders = make_orders(spark, [
        order_row("A", "2024-01-01", "2024-01-03", prod="P1", sales=10.0, qty=1),
        order_row("A", "2024-01-01", "2024-01-05", prod="P2", sales=20.0, qty=1),
        order_row("B", "2024-01-01", "2024-01-02", prod="P1", sales=5.0, qty=1),
        order_row(None, "2024-01-01", "2024-01-02", prod="P9", sales=1.0, qty=1),
    ])
    products = spark.createDataFrame(
        [("P1", "t1", 1.0, "Cat1", "", None), ("P2", "t2", 1.0, "Cat1", "", None)],
        "id string, title string, price double, category string, description string, image string")
    returns = make_returns(spark, [(d("2024-01-05"), "A", "C1", "P1", None, None)] * 2
                           + [(d("2024-01-05"), "A", "C1", "P2", None, None)])
    returns = returns.withColumn("return_id", F.concat(F.lit("R"), F.monotonically_increasing_id().cast("string")))
    fo, dp, fr = W.fact_orders(orders), W.dim_products(products), W.fact_returns(returns)
    got = {r["category"]: r.asDict() for r in MT.mart_vendor_performance(fo, dp, fr).collect()}
    cat1 = got["Cat1"]
    assert cat1["total_orders"] == 2
    assert cat1["total_sales"] == 3 * 30.0 + 5.0          # order A lines repeated per return
    assert cat1["total_returns"] == 3
    assert cat1["return_rate"] == 1.5
    assert cat1["avg_lead_time"] == round((3 * (2 + 4) + 1) / 7, 6)
    assert got[None]["total_orders"] == 0 and got[None]["total_sales"] == 1.0
    fixed = {r["category"]: r.asDict() for r in MT.mart_vendor_performance_line_grain(fo, dp, fr).collect()}
    assert fixed["Cat1"]["total_sales"] == 35.0 and fixed["Cat1"]["total_returns"] == 3


def test_location_id_and_missing_optional_columns(spark):
    o = make_orders(spark, [order_row("A", "2024-01-01", "2024-01-02", country="US", state="CA"),
                            order_row("B", "2024-01-01", "2024-01-02", country="US", state=None)])
    locs = [r["location_id"] for r in W.fact_orders(o).orderBy("order_id").collect()]
    assert locs == ["US_CA", None]  # NULL part -> NULL id, not 'US_'
    assert {r["location_id"] for r in W.fact_orders(o.drop("state")).collect()} == {"Unknown"}
    raw = make_orders(spark, [order_row("A", "2024-01-01", "2024-01-02", sales=3.0, qty=2)], enrich=False)
    from chainlens.operators.transforms import enrich_orders
    assert one(enrich_orders(raw).select("order_value"))["order_value"] == 6.0
    assert one(enrich_orders(raw.drop("quantity")).select("order_value"))["order_value"] == 3.0
    assert "order_value" not in enrich_orders(raw.drop("quantity", "sales")).columns


def test_paging_zero_and_none_are_ignored(spark):
    o = make_orders(spark, [order_row(f"O{i:02d}", "2024-01-01", "2024-01-02") for i in range(10)])
    assert D.page(o, ["order_id"], limit=None, offset=None).count() == 10
    assert D.page(o, ["order_id"], limit=0, offset=0).count() == 10
    assert [r["order_id"] for r in D.page(o, ["order_id"], limit=3, offset=4).collect()] == ["O04", "O05", "O06"]
    assert [r["order_id"] for r in D.page_after(o, ["order_id"], ("O05",), 2).collect()] == ["O06", "O07"]


def test_missing_share_nan_null_and_empty(spark):
    df = spark.createDataFrame([(1.0, "a", None), (float("nan"), "b", 2)], "x double, y string, z int")
    r = one(Q.missing_share(df, "t"))
    assert (r["null_cells"], r["total_cells"], r["status"]) == (2, 6, "WARNING")
    e = one(Q.missing_share(df.limit(0), "t"))
    assert e["missing_share"] is None and e["status"] == "PASS"


def test_required_columns_fail_lists_names(spark):
    o = make_orders(spark, [order_row("A", "2024-01-01", "2024-01-02")]).drop("ship_date")
    got = {r["table_name"]: r.asDict() for r in Q.dq_required_columns(o).collect()}
    assert got["orders_sheet"]["status"] == "FAIL" and got["orders_sheet"]["missing_columns"] == "Ship Date"
    assert got["orders_api"]["status"] == "PASS"


def test_alerts(spark):
    o = make_orders(spark, [order_row("A", "2024-01-01", "2024-01-20", state=None),
                            order_row("B", "2024-01-01", "2024-01-02")])
    inv = make_inventory(spark, [inv_row("2024-01-01", "P1", risk=True)])
    got = {r["alert"]: r.asDict() for r in Q.alerts(o, inv).collect()}
    assert got["stockout"]["value"] == 1.0
    assert got["high_lead_time"] == {"alert": "high_lead_time", "value": 1.0}
    assert "missing_data" not in got  # 1 of 36 cells missing
    normal = make_orders(spark, [order_row("B", "2024-01-01", "2024-01-02")])
    assert Q.alerts(normal, make_inventory(spark, [inv_row("2024-01-01", "P1")])).count() == 0


def test_floor_day_diff_vs_calendar_days(spark):
    df = spark.createDataFrame([("2024-01-01 23:00:00", "2024-01-02 01:00:00")], "a string, b string") \
        .select(F.to_timestamp("a").alias("a"), F.to_timestamp("b").alias("b"))
    r = one(df.select(C.floor_day_diff("b", "a").alias("fwd"), C.floor_day_diff("a", "b").alias("back"),
                      C.day_diff(F.to_date("b"), F.to_date("a")).alias("cal")))
    assert (r["fwd"], r["back"], r["cal"]) == (0, -1, 1)


def test_low_stock_window_and_aggregate_agree(spark):
    inv = make_inventory(spark, [inv_row("2024-01-01", "P1", stock=100), inv_row("2024-01-02", "P1", stock=5),
                                 inv_row("2024-01-03", "P1", stock=50), inv_row("2024-01-01", "P2", stock=0)])
    a = sorted(tuple(r) for r in D.low_stock_vs_max(inv).collect())
    b = sorted(tuple(r) for r in D.low_stock_vs_max(inv, method="window").collect())
    assert a == b and [(r[1], r[3]) for r in a] == [("P1", 5)]


def test_histogram_covers_all_rows(spark):
    o = make_orders(spark, [order_row(f"O{i}", "2024-01-01", f"2024-01-{1 + i:02d}") for i in range(20)])
    h = D.lead_time_histogram(o).collect()
    assert sum(r["orders"] for r in h) == 20 and max(r["bin_index"] for r in h) == 19
    assert min(r["bin_start"] for r in h) == 0.0 and math.isclose(max(r["bin_end"] for r in h), 19.0)


def test_json_records_keep_types(spark):
    import json
    from chainlens.plans.report import json_records
    df = spark.createDataFrame([(d("2024-01-02"), float("inf"), None, 12345678.5, 3, True),
                                (None, float("nan"), 'x "y":null', None, None, None)],
                               "dt date, a double, s string, b double, n bigint, t boolean")
    rows = [json.loads(r["record"]) for r in json_records(df).collect()]
    assert rows[0] == {"dt": "2024-01-02", "a": "", "s": "", "b": 12345678.5, "n": 3, "t": True}
    assert rows[1] == {"dt": "", "a": "", "s": 'x "y":null', "b": "", "n": "", "t": ""}
    none = spark.createDataFrame([(None,)], "x double")
    assert json_records(none).first()["record"] == '{"x":""}'


def test_money_keeps_all_digits(spark):
    o = make_orders(spark, [order_row(f"O{i}", "2024-01-01", "2024-01-02", sales=0.004, profit=0.0001) for i in range(5000)])
    assert D.category_sales_total(o).first()["total_sales"] == 20.0
    fo = W.fact_orders(o)
    products = spark.createDataFrame([("P1", "t", 1.0, "Furniture", "", None)],
                                     "id string, title string, price double, category string, description string, image string")
    returns = make_returns(spark, [(d("2024-01-05"), "O1", "C1", "P1", None, None)] * 3).withColumn("return_id", F.lit("R"))
    r = MT.mart_vendor_performance(fo, W.dim_products(products), W.fact_returns(returns)).first()
    assert (r["total_sales"], r["total_profit"]) == (20.008, 0.5002)  # one line counts three times
    assert MT.mart_fulfillment_analytics(fo, W.dim_products(products)).first()["total_sales"] == 20.0


def test_lead_time_of_timestamps_counts_elapsed_days(spark):
    from chainlens.operators.transforms import enrich_orders
    for kind in ("string", "timestamp", "timestamp_ntz"):
        df = spark.createDataFrame([("2024-03-09 23:00:00", "2024-03-10 01:00:00"), ("2024-03-09 00:00:00", "2024-03-11 00:00:00"),
                                    ("2024-03-10 01:00:00", "2024-03-09 23:00:00")], "order_date string, ship_date string")
        df = df.select(*[F.col(c).cast(kind).alias(c) for c in df.columns])
        assert [r["lead_time_days"] for r in enrich_orders(df).collect()] == [0, 2, -1], kind


def test_equal_return_rows_get_ids_of_their_own(spark):
    row = (d("2024-01-05"), "A", "C1", "P1", "Furniture", "West")
    ids = [r["return_id"] for r in W.fact_returns(make_returns(spark, [row, row, row[:1] + ("B",) + row[2:]])).collect()]
    assert len(set(ids)) == 3
    again = [r["return_id"] for r in W.fact_returns(make_returns(spark, [row, row])).collect()]
    assert set(again) < set(ids)


def test_offset_without_limit_is_not_one_task(spark):
    o = make_orders(spark, [order_row(f"O{i:02d}", "2024-01-01", "2024-01-02") for i in range(10)]
                    + [order_row(None, "2024-01-01", "2024-01-02")])
    page = D.page(o, ["order_id"], offset=4)
    assert [r["order_id"] for r in page.collect()] == [f"O{i:02d}" for i in range(3, 10)]  # the NULL comes first
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "CollectLimit" not in plan and "SinglePartition" not in plan
    assert D.page(o, ["order_id"], offset=50).count() == 0


def test_dimensions_are_not_sorted_over_lines(spark):
    o = make_orders(spark, [order_row("A", "2024-01-01", "2024-01-02")])
    people = spark.createDataFrame([("C1", "n", "s", "r")], "customer_id string, customer_name string, segment string, region string")
    for df in (W.dim_customers(people, o), W.dim_locations(o)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        first = [x for x in plan.split("\n") if "Aggregate" in x][-1]  # nearest to the scan
        assert "HashAggregate" in first, plan


def test_analytics_summary_safe_ratio(spark):
    o = make_orders(spark, [])
    r = one(D.analytics_summary(o, make_returns(spark, []), o.select("customer_id")))
    assert r["total_orders"] == 0 and r["avg_order_value"] == 0.0 and r["total_sales"] == 0.0


def test_category_join_form_equals_single_groupby(spark):
    from conftest import SF_SMALL
    from chainlens.sources import fixtures as FX
    o = FX.tables(spark, SF_SMALL).orders
    joined = M.category_sales(o).join(M.category_lead_time(o), "category")
    single = M.category_performance(o)
    cols = sorted(single.columns)
    assert sorted(tuple(r) for r in joined.select(cols).collect()) == \
        sorted(tuple(r) for r in single.select(cols).collect())


def test_observe_required_nulls_during_write(spark, tmp_root):
    o = make_orders(spark, [order_row("A", "2024-01-01", "2024-01-02"), order_row(None, "2024-01-01", None)])
    fo = W.fact_orders(o)
    observed, obs = Q.observe_required_nulls(fo, "fact_orders")
    observed.write.mode("overwrite").parquet(tmp_root + "/obs")
    assert obs.get["order_id"] == 1 and obs.get["sales"] == 0


def test_cluster_conf_sizes_partitions():
    from chainlens.session import cluster_conf
    small = cluster_conf(10e9, executors=10, cores_per_executor=4)
    assert int(small["spark.sql.shuffle.partitions"]) == 80      # two waves of 40 slots
    big = cluster_conf(100e12)
    assert int(big["spark.sql.shuffle.partitions"]) == int(100e12 // (256 << 20)) + 1
    assert int(big["spark.sql.autoBroadcastJoinThreshold"]) == 64 << 20
