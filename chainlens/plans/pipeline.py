"""End-to-end batch job: extract -> checks -> warehouse -> marts -> metrics / report.

C-1  ``all_metrics``  every metric family as a DataFrame
C-4  ``build_marts``  compute and write the marts from warehouse tables
C-3  ``run``          the full job

Order lines, returns, inventory, people and products are written once to the
shared folder as they are extracted; checks, warehouse, marts, KPIs, alerts
and the report read those files.  Each source is thus read once, and a lost
executor recomputes from Parquet files, not from the source joins.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from chainlens.operators import dashboard as D
from chainlens.operators import marts as MT
from chainlens.operators import metrics as M
from chainlens.operators import quality as Q
from chainlens.plans import report as R
from chainlens.plans import warehouse as W
from chainlens.session import apply_conf, cluster_conf, input_bytes, scratch_path
from chainlens.sources import files as SRC
from chainlens.sources import fixtures as FX
from chainlens.sources import snapshots as SNAP


def all_metrics(orders: DataFrame, inventory: DataFrame, returns: DataFrame) -> dict[str, DataFrame]:
    """The six families (plus breakdowns).  All are lazy but for the medians of
    turnover, days of inventory and fill rate, which are found when this is called."""
    return {
        "lead_time": M.lead_time_metrics(orders),
        "order_cycle": M.order_cycle_time_metrics(orders),
        "inventory_turnover": M.inventory_turnover_metrics(inventory),
        "days_of_inventory": M.days_of_inventory_metrics(inventory),
        "fill_rate": M.fill_rate_metrics(inventory),
        "stockout": M.stockout_risk_metrics(inventory),
        "category_performance": M.category_performance(orders),
        "top_sales_category": M.top_sales_category(orders),
        "best_lead_time_category": M.best_lead_time_category(orders),
        "returns": M.return_metrics(orders, returns),
        "returns_by_category": M.returns_by(returns, "category"),
        "returns_by_region": M.returns_by(returns, "region"),
    }


MARTS = ("mart_vendor_performance", "mart_inventory_analysis", "mart_fulfillment_analytics",
         "mart_category_performance", "mart_vendor_performance_line_grain",
         "mart_category_performance_line_grain")


def mart_frames(wh: dict[str, DataFrame], skew_share: float | None = None) -> dict[str, DataFrame]:
    fo, dp, fr, fi = wh["fact_orders"], wh["dim_products"], wh["fact_returns"], wh["fact_inventory"]
    k = {"skew_share": skew_share}
    return {
        "mart_vendor_performance": MT.mart_vendor_performance(fo, dp, fr, **k),
        "mart_inventory_analysis": MT.mart_inventory_analysis(fi, dp, **k),
        "mart_fulfillment_analytics": MT.mart_fulfillment_analytics(fo, dp, **k),
        "mart_category_performance": MT.mart_category_performance(fo, dp, fr, fi, **k),
        "mart_vendor_performance_line_grain": MT.mart_vendor_performance_line_grain(fo, dp, fr, **k),
        "mart_category_performance_line_grain": MT.mart_category_performance_line_grain(fo, dp, fr, fi, **k),
    }


def build_marts(wh: dict[str, DataFrame], root: str | None = None, database: str | None = None,
                skew_share: float | None = None) -> list[str]:
    """Create or replace every mart.  A mart is published as a whole when it
    is written: below ``root`` as a version (``read_mart``), in a database by
    pointing its view at a new table; a job that fails leaves the old one."""
    written = []
    for name, df in mart_frames(wh, skew_share).items():
        if database:
            SNAP.replace_view(df, database, name)
        else:
            SNAP.replace(df, os.path.join(root, name))
        written.append(name)
    return written


def read_mart(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """One version of a mart, the last one by default."""
    return SNAP.read(spark, os.path.join(root, name), version)


def extract(spark: SparkSession, root: str, sf_dir: str | None = None, landed: dict[str, str] | None = None,
            fmt: str = "csv", formats: dict[str, str] | None = None, skew_share: float | None = None) -> dict[str, DataFrame]:
    """The input tables, each written once below ``root``: those landed
    (orders / returns / people) first, others from the test tables."""
    tables: dict[str, DataFrame] = dict(SRC.load_all(spark, landed or {}, fmt, formats))
    if sf_dir:
        t = FX.tables(spark, sf_dir, skew_share=skew_share)
        for name in ("orders", "returns", "people", "products", "inventory"):
            if name not in tables:
                tables[name] = getattr(t, name)
    out = {}
    for name, df in tables.items():
        path = os.path.join(root, name)
        df.write.mode("overwrite").parquet(path)
        out[name] = spark.read.schema(df.schema).parquet(path)
    return out


def run(spark: SparkSession, sf_dir: str | None = None, root: str | None = None, database: str | None = None,
        landed: dict[str, str] | None = None, fmt: str = "csv", formats: dict[str, str] | None = None,
        skew_share: float | None = 0.01, executors: int | None = None) -> dict[str, str]:
    """Full batch job over the test tables of ``sf_dir`` and / or landed files.

    ``database``: load the declared tables of that database instead of
    folders.  ``executors``: size shuffles for that cluster from the bytes
    read.  Returns the locations written.  Every step is a distributed write;
    the driver only sequences the jobs (and receives at most 1 / skew_share
    hot keys a join).  Outputs whose inputs are absent are left out."""
    root = root or scratch_path(spark, "chainlens-run")
    if executors:
        paths = list((landed or {}).values()) + ([sf_dir] if sf_dir else [])
        apply_conf(spark, cluster_conf(input_bytes(spark, paths), executors))
    t = extract(spark, os.path.join(root, "extracted"), sf_dir, landed, fmt, formats, skew_share)
    out = {"root": root}

    def save(name: str, df: DataFrame) -> None:
        out[name] = os.path.join(root, name)
        df.write.mode("overwrite").parquet(out[name])

    save("dq_missing_cells", Q.dq_missing_cells(t))
    save("table_profile", Q.table_profile(t))
    if "orders" in t:
        save("dq_required_columns", Q.dq_required_columns(t["orders"]))

    wh_root = os.path.join(root, "warehouse")
    W.load_warehouse(t, database=database, root=None if database else wh_root)
    wh = W.read_warehouse(spark, database=database, root=None if database else wh_root)
    out["warehouse"] = database or wh_root
    loaded = [n for n in W.dimension_and_fact_frames(t)]
    save("dq_required_nulls", Q.dq_required_nulls({n: wh[n] for n in loaded}))
    if {"orders", "products", "returns", "inventory"} <= set(t):
        out["marts"] = database or os.path.join(root, "marts")
        build_marts(wh, root=None if database else out["marts"], database=database, skew_share=skew_share)
    if {"orders", "inventory"} <= set(t):
        save("alerts", Q.alerts(t["orders"], t["inventory"]))
        save("kpi_cards", D.kpi_cards(t["orders"], t["inventory"]))
        if "returns" in t:
            out["summary_report"] = os.path.join(root, "summary_report")
            R.write_summary_report(R.summary_report(t["orders"], t["inventory"], t["returns"]), out["summary_report"])
    return out
