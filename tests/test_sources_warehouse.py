"""Landed files, JSON envelopes, source combination, warehouse round trip."""

from __future__ import annotations

import contextlib
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, make_orders, order_row
from chainlens import schemas
from chainlens.plans import report as R
from chainlens.plans import warehouse as W
from chainlens.sources import files as SRC
from chainlens.sources import fixtures as FX

SHEET = ["Order ID", "Order Date", "Ship Date", "Customer ID", "Product ID", "Category", "Quantity", "Sales",
         "Profit", "Discount", "Country", "State", "Region"]


def _write_csv(path, rows):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.csv"), "w") as f:
        f.write(",".join(SHEET) + "\n")
        for r in rows:
            f.write(",".join("" if v is None else str(v) for v in r) + "\n")


def test_landed_csv_orders(spark, tmp_root):
    p = os.path.join(tmp_root, "orders_csv")
    _write_csv(p, [["A", "2024-01-01", "2024-01-04", "C1", "PROD_01", "Furniture", 2, 10.5, 1.0, 0.1, "US", "CA", "West"],
                   ["B", "2024-01-02", "", "C2", "PROD_02", "", 1, "NaN", "", 0.0, "US", "", "East"]])
    df = SRC.load_orders(spark, p)
    rows = {r["order_id"]: r.asDict() for r in df.collect()}
    assert rows["A"]["lead_time_days"] == 3 and rows["A"]["order_value"] == 21.0
    assert rows["A"]["order_quarter"] == 1 and rows["A"]["product_id"] == "PROD_01"
    assert rows["B"]["lead_time_days"] is None and rows["B"]["sales"] is None  # NaN -> NULL


def _write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write(text)
    return path


def test_csv_is_read_by_header_name(spark, tmp_root):
    p = _write(os.path.join(tmp_root, "swapped"), "a.csv",
               "Ship Date,Order Date,Order ID,Note,Customer ID,Product ID\n2024-01-09,2024-01-01,A,hello,C1,P1\n")
    df = SRC.load_orders(spark, p)
    r = df.first()
    assert (r["order_id"], r["lead_time_days"], r["Note"]) == ("A", 8, "hello")
    assert not {"category", "state", "country", "sales"} & set(df.columns)  # absent stays absent
    from chainlens.operators import quality as Q
    assert {x["status"] for x in Q.dq_required_columns(df).collect()} == {"PASS"}
    o = W.fact_orders(df.withColumns({c: F.lit(1.0) for c in ("quantity", "sales", "profit", "discount", "order_value")}))
    assert o.first()["location_id"] == "Unknown"
    q = _write(os.path.join(tmp_root, "short"), "a.csv", "Order ID,Order Date\nA,2024-01-01\n")
    got = {x["table_name"]: (x["status"], x["missing_columns"]) for x in Q.dq_required_columns(SRC.load_orders(spark, q)).collect()}
    assert got == {"orders_sheet": ("FAIL", "Ship Date, Customer ID, Product ID"),
                   "orders_api": ("FAIL", "Customer ID, Product ID")}


def test_broken_input_fails_instead_of_vanishing(spark, tmp_root):
    env = _write(os.path.join(tmp_root, "env_bad"), "a.json", '{"status": "ok", "data": [{"Order ID": "A"')
    lines = _write(os.path.join(tmp_root, "lines_bad"), "a.json", '{"Order ID": "A"}\n{"Order ID": \n')
    doc = _write(os.path.join(tmp_root, "doc_bad"), "a.json", '{"regional_sales": ')
    csv = _write(os.path.join(tmp_root, "csv_bad"), "a.csv", "Order ID,Quantity\nA,many\n")
    for read in (lambda: SRC.read_envelope(spark, env, schemas.ORDERS), lambda: SRC.load_orders(spark, lines, fmt="json"),
                 lambda: SRC.read_analytics_doc(spark, doc), lambda: SRC.load_orders(spark, csv),
                 lambda: SRC.parse_envelope_column(spark.createDataFrame([("{",)], "t string"), "t", schemas.ORDERS)):
        with pytest.raises(Exception):
            read().collect()


def test_malformed_date_strict_and_lenient(spark, tmp_root):
    p = os.path.join(tmp_root, "bad_csv")
    _write_csv(p, [["A", "2024-13-45", "2024-01-04", "C1", "P", "F", 1, 1.0, 1.0, 0.0, "US", "CA", "W"]])
    with pytest.raises(Exception):
        SRC.load_orders(spark, p).collect()
    assert SRC.load_orders(spark, p, lenient=True).first()["order_date"] is None


def test_json_envelope_and_analytics_doc(spark, tmp_root):
    env = {"status": "success", "count": 2, "data": [
        {"Order ID": "A", "Order Date": "2024-01-01", "Ship Date": "2024-01-03", "Customer ID": "C1",
         "Product ID": "P1", "Sales": 5.0, "Quantity": 2},
        {"Order ID": "B", "Order Date": "2024-01-02", "Ship Date": "2024-01-02", "Customer ID": "C2",
         "Product ID": "P2", "Sales": 7.0, "Quantity": 1}]}
    p = os.path.join(tmp_root, "env")
    os.makedirs(p)
    with open(os.path.join(p, "orders.json"), "w") as f:
        json.dump(env, f)
    rows = SRC.read_envelope(spark, p, schemas.ORDERS)
    assert sorted(r["order_id"] for r in rows.collect()) == ["A", "B"]
    doc = {"summary": {"total_orders": 2, "total_returns": 0, "total_customers": 2, "total_sales": 12.0,
                       "avg_order_value": 6.0},
           "regional_sales": {"West": 12.0}, "category_sales": {"F": 5.0, "T": 7.0},
           "monthly_sales": {"2024-01": 12.0}}
    q = os.path.join(tmp_root, "doc")
    os.makedirs(q)
    with open(os.path.join(q, "a.json"), "w") as f:
        json.dump(doc, f)
    long = SRC.read_analytics_doc(spark, q)
    assert long.count() == 4
    assert {r["key"] for r in long.where("breakdown = 'category_sales'").collect()} == {"F", "T"}


def test_combine_and_resolve_sources(spark):
    a = make_orders(spark, [order_row("A", "2024-01-01", "2024-01-02"), order_row("B", "2024-01-01", "2024-01-02")])
    b = make_orders(spark, [order_row("B", "2024-01-01", "2024-01-09"), order_row("C", "2024-01-01", "2024-01-02")])
    c = SRC.combine_sources(a, b.drop("region"), ["order_id"])
    got = {r["order_id"]: r["lead_time_days"] for r in c.collect()}
    assert got == {"A": 1, "B": 1, "C": 1}  # primary wins for B
    assert SRC.resolve_source(None, b) is b and SRC.resolve_source(a, b) is a


def test_warehouse_round_trip_and_idempotent_overwrite(spark, tmp_root):
    t = FX.tables(spark, SF_SMALL)
    src = {"products": t.products, "orders": t.orders, "inventory": t.inventory,
           "returns": t.returns, "people": t.people}
    root = os.path.join(tmp_root, "wh")
    done = W.load_warehouse(src, root=root)
    assert set(done) == set(schemas.WAREHOUSE_DDL)
    wh = W.read_warehouse(spark, root=root)
    assert wh["fact_orders"].count() == t.orders.count()
    assert wh["fact_returns"].count() == t.returns.count()
    assert wh["fact_inventory"].count() == t.inventory.count()
    assert set(W.fact_orders(t.orders).columns) <= set(wh["fact_orders"].columns)
    W.load_warehouse(src, root=root)  # second load replaces, never appends
    assert W.read_warehouse(spark, root=root)["fact_orders"].count() == t.orders.count()
    # day partitions are prunable
    one_day = wh["fact_orders"].where(F.col("order_date") == F.lit("1996-03-01").cast("date"))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        one_day.explain()
    assert "PartitionFilters: [isnotnull(order_date" in buf.getvalue()


def test_catalog_ddl(spark):
    W.create_database(spark, "chainlens_test_db")
    made = W.create_star_schema(spark, "chainlens_test_db")
    assert len(made) == 7
    assert "order_date" in spark.table("chainlens_test_db.fact_orders").columns
    assert W.create_star_schema(spark, "chainlens_test_db") == made  # IF NOT EXISTS


def test_summary_report_and_csv(spark, tmp_root):
    t = FX.tables(spark, SF_SMALL)
    rep = R.summary_report(t.orders, t.inventory, t.returns)
    fams = {r["metric_type"] for r in rep.collect()}
    assert fams == {"lead_time", "order_cycle", "inventory_turnover", "fill_rate", "category_performance", "returns"}
    out = os.path.join(tmp_root, "report_csv")
    R.write_summary_report(rep, out)
    back = spark.read.option("header", True).csv(out)
    assert back.count() == rep.count()
    base = R.export_report(t.orders, t.inventory, os.path.join(tmp_root, "exports"), stamp="20240101_000000")
    assert spark.read.parquet(base + "/summary").count() == 1


def test_read_warehouse_raises(spark, tmp_root):
    with pytest.raises(FileNotFoundError):
        W.read_warehouse(spark, root=os.path.join(tmp_root, "nothing"))
    bad = _write(os.path.join(tmp_root, "broken", "dim_time"), "a.parquet", "not parquet")
    with pytest.raises(Exception):
        {k: v.count() for k, v in W.read_warehouse(spark, root=os.path.dirname(bad)).items()}


def test_pipeline_run_writes_marts_equal_to_direct(spark, tmp_root):
    from chainlens.plans import pipeline as P
    from chainlens.queries import QUERIES
    out = P.run(spark, SF_SMALL, root=os.path.join(tmp_root, "run"))
    for name in P.MARTS:
        written = sorted((tuple(r) for r in P.read_mart(spark, out["marts"], name).collect()), key=str)
        direct = sorted((tuple(r) for r in QUERIES[name](spark, SF_SMALL).collect()), key=str)
        assert written == direct, name
    rep = spark.read.option("header", True).csv(out["summary_report"])
    assert rep.count() > 40
    assert spark.read.parquet(out["dq_required_nulls"]).select("table_name").distinct().count() == 7
    fams = P.all_metrics(*(lambda t: (t.orders, t.inventory, t.returns))(FX.tables(spark, SF_SMALL)))
    assert fams["lead_time"].count() == 1


def test_pipeline_into_a_database_with_landed_orders(spark, tmp_root):
    from chainlens.plans import pipeline as P
    landed = _write(os.path.join(tmp_root, "landed"), "o.csv",
                    "Order ID,Product ID,Customer ID,Order Date,Ship Date,Category,Quantity,Sales,Profit,Discount,Region\n"
                    "A,1,1,2024-01-01,2024-01-20,ECONOMY,2,10.1234,1.5,0.1,ASIA\n"
                    "B,2,2,2024-01-02,2024-01-03,LARGE,1,5.5,0.5,0.0,EUROPE\n")
    db = "chainlens_run_db"
    out = P.run(spark, SF_SMALL, root=os.path.join(tmp_root, "dbrun"), database=db, landed={"orders": landed})
    fo = spark.table(f"{db}.fact_orders")
    assert fo.columns == [c.split()[0] for c in schemas.WAREHOUSE_DDL["fact_orders"][0].split(", ")]
    assert sorted((r["order_id"], r["lead_time_days"], r["location_id"]) for r in fo.collect()) == \
        [("A", 19, "Unknown"), ("B", 1, "Unknown")]
    assert {r["alert"] for r in spark.read.parquet(out["alerts"]).collect()} >= {"high_lead_time"}
    assert spark.table(f"{db}.mart_fulfillment_analytics").count() == 2
    P.run(spark, SF_SMALL, root=os.path.join(tmp_root, "dbrun2"), database=db, landed={"orders": landed})
    assert spark.table(f"{db}.fact_orders").count() == 2  # loaded again, not appended


def test_month_grain_partitions(spark, tmp_root):
    t = FX.tables(spark, SF_SMALL)
    root = os.path.join(tmp_root, "wh_month")
    W.load_warehouse({"orders": t.orders}, root=root, grain="month")
    parts = [p for p in os.listdir(os.path.join(root, "fact_orders")) if p.startswith("order_date_month=")]
    fo = spark.read.parquet(os.path.join(root, "fact_orders"))
    assert 0 < len(parts) <= 12 * 8 and fo.count() == t.orders.count()
    assert "order_date" in fo.columns


def test_landed_json_lines_parquet_and_load_all(spark, tmp_root):
    rows = [{"Order ID": "A", "Order Date": "2024-03-01", "Ship Date": "2024-03-05", "Customer ID": "C1",
             "Product ID": "P1", "Category": "Technology", "Quantity": 3, "Sales": 2.5},
            {"Order ID": "B", "Order Date": "2024-03-02", "Ship Date": "2024-03-02", "Customer ID": "C2",
             "Product ID": "P2", "Category": "Furniture", "Quantity": 1, "Sales": 4.0}]
    jp = os.path.join(tmp_root, "orders_jsonl")
    os.makedirs(jp)
    with open(os.path.join(jp, "part-0.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows) + "\n")
    o = SRC.load_orders(spark, jp, fmt="json")
    got = {r["order_id"]: (r["lead_time_days"], r["order_value"]) for r in o.collect()}
    assert got == {"A": (4, 7.5), "B": (0, 4.0)}
    pq = os.path.join(tmp_root, "orders_parquet")
    o.write.parquet(pq)
    again = SRC.load_orders(spark, pq, fmt="parquet")
    assert sorted(tuple(r) for r in again.collect()) == sorted(tuple(r) for r in o.collect())
    people_p = os.path.join(tmp_root, "people_csv")
    os.makedirs(people_p)
    with open(os.path.join(people_p, "p.csv"), "w") as f:
        f.write("Customer ID,Customer Name,Segment,Region,First Order Date,Last Order Date\n"
                "C1,Ann,Consumer,West,2024-01-01,2024-03-01\n")
    all_ = SRC.load_all(spark, {"orders": jp, "people": people_p}, fmt="json", formats={"people": "csv"})
    assert set(all_) == {"orders", "people"}
    p = all_["people"].first()
    assert (p["customer_id"], str(p["first_order_date"]), str(p["last_order_date"])) == \
        ("C1", "2024-01-01", "2024-03-01")
    assert all_["orders"].count() == 2


def test_envelope_in_text_column(spark):
    from chainlens import schemas as S
    doc = json.dumps({"status": "success", "count": 1, "data": [
        {"return_date": "2024-01-01", "order_id": "A", "customer_id": "C1", "product_id": "P1"}]})
    df = spark.createDataFrame([(doc,)], "body string")
    rows = SRC.parse_envelope_column(df, "body", S.RETURNS).collect()
    assert [(r["order_id"], str(r["return_date"])) for r in rows] == [("A", "2024-01-01")]
