"""Reports and exports: the long metric report, metric profile, JSON record
export and the multi-dataset export folder."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlens import settings
from chainlens.functions import columns as C
from chainlens.functions.frames import one_row_join
from chainlens.operators import dashboard as D
from chainlens.operators import metrics as M
from chainlens.operators.quantiles import exact_medians


def _merged(df: DataFrame, families: dict[str, tuple[dict[str, Column], str]],
            extra: list[Column] = ()) -> DataFrame:
    """Several families in ONE aggregate pass; columns become tag__name."""
    exprs = list(extra)
    for tag, (cols, _n) in families.items():
        exprs += [c.alias(f"{tag}__{name}") for name, c in cols.items()]
    return df.agg(*exprs)


def summary_report(orders: DataFrame, inventory: DataFrame, returns: DataFrame) -> DataFrame:
    """Long report (metric_type, metric, value, label).

    Work per input: one global aggregate over order lines (lead and cycle
    families + row count), one per-category aggregate (top / best category),
    one global aggregate over inventory (turnover, days, fill rate,
    stockout), one over returns and one grouped count of returns.  The five
    single-row results are put side by side and unpivoted with ``explode`` in
    a single projection; a family is emitted only when it saw input rows.
    """
    o_fams = {"lt": M.lead_time_exprs(F.col("lead_time_days")), "ct": M.cycle_time_exprs()}
    medians = exact_medians(inventory, {"to": M.TURNOVER, "di": M.days_of_inventory(), "fr": M.FILL_RATE})
    i_fams = {"to": M.turnover_exprs(medians["to"]), "di": M.days_of_inventory_exprs(medians["di"]),
              "fr": M.fill_rate_exprs(medians["fr"]), "so": M.stockout_exprs()}
    o1 = _merged(orders, o_fams, [F.count(F.lit(1)).alias("rt__orders_rows")])
    i1 = _merged(inventory, i_fams)
    cat = M.category_performance(orders)  # one row a category; feeds the breakdown and the top / best rows
    c1 = cat.agg(
        F.min_by(F.struct("category", "total_sales", "unique_orders"),
                 F.struct(-F.col("total_sales"), F.col("category"))).alias("top"),
        F.min_by(F.struct("category", "avg_lead_time", "order_count"),
                 F.when(F.col("avg_lead_time").isNotNull(),
                        F.struct(F.col("avg_lead_time"), F.col("category")))).alias("best"),
        F.count(F.lit(1)).alias("n_cat"),
        F.count("avg_lead_time").alias("n_best"))
    # the returns aggregate is the main branch (its grouped rows also feed
    # the breakdown, so Spark reuses that one shuffle); the three other
    # single-row aggregates are attached as scalar subqueries
    rb = returns_grouped(returns)
    r1 = rb.where(F.col("gid") == 3).select(F.col("returned").alias("rt__returned"), F.col("n").alias("rt__items"))
    wide = one_row_join(one_row_join(one_row_join(r1, o1), i1), c1)

    # (gate, family, metric, numeric value, text label) as SQL text: the
    # whole unpivot is ONE stack() generator over the single wide row
    rows: list[tuple[str, str, str, str, str]] = []
    layout = [("lead_time", "lt", o_fams), ("order_cycle", "ct", o_fams), ("inventory_turnover", "to", i_fams),
              ("inventory_turnover", "di", i_fams), ("fill_rate", "fr", i_fams), ("fill_rate", "so", i_fams)]
    for family, tag, fams in layout:
        gate = f"{tag}__{fams[tag][1]} > 0"
        rows += [(gate, family, name, f"{tag}__{name}", "NULL") for name in fams[tag][0] if not name.startswith("_")]
    cat_rows = [("n_cat > 0", "top_sales_category", "top", ["total_sales", "unique_orders"]),
                ("n_best > 0", "best_lead_time_category", "best", ["avg_lead_time", "order_count"])]
    for gate, prefix, struct, fields in cat_rows:
        for f in fields:
            metric = f"{prefix}.{'order_count' if f == 'unique_orders' else f}"
            rows.append((gate, "category_performance", metric, f"{struct}.{f}", "NULL"))
        rows.append((gate, "category_performance", f"{prefix}.category", "NULL", f"{struct}.category"))
    rate = (f"ROUND(COALESCE(try_divide(CAST(rt__returned AS DOUBLE), CAST(rt__orders_rows AS DOUBLE)), "
            f"CAST(0 AS DOUBLE)), {settings.RATIO_DECIMALS})")
    for metric, value in [("return_rate", rate), ("total_orders", "rt__orders_rows"),
                          ("total_returned_orders", "rt__returned"), ("total_return_items", "rt__items")]:
        rows.append(("rt__orders_rows > 0", "returns", metric, value, "NULL"))
    body = ", ".join(f"{g}, '{fam}', '{m}', CAST({v} AS DOUBLE), CAST({lab} AS STRING)" for g, fam, m, v, lab in rows)
    scalars = (wide.selectExpr(f"stack({len(rows)}, {body}) AS (keep, metric_type, metric, value, label)")
               .where("keep").drop("keep"))
    return scalars.unionByName(category_breakdown(cat)).unionByName(returns_breakdown(rb))


BREAKDOWN = ("total_sales", "avg_sale", "total_items", "unique_orders", "avg_lead_time", "median_lead_time",
             "std_lead_time", "order_count")


def category_breakdown(cat: DataFrame) -> DataFrame:
    """Report rows 'category_breakdown.<category>.<measure>'."""
    rows = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in BREAKDOWN)
    return cat.selectExpr("category", f"stack({len(BREAKDOWN)}, {rows}) AS (measure, value)").select(
        F.lit("category_performance").alias("metric_type"),
        F.concat(F.lit("category_breakdown."), "category", F.lit("."), "measure").alias("metric"), "value",
        F.lit(None).cast("string").alias("label"))


def returns_grouped(returns: DataFrame) -> DataFrame:
    """Returns counted by category, by region and overall in ONE
    grouping-sets pass.  gid 1 = per category, 2 = per region, 3 = total;
    ``returned`` = distinct returned order ids (a NULL id counts once)."""
    r = returns.select("category", "region", F.col("order_id").cast("string").alias("_oid"))
    return (r.groupingSets([["category"], ["region"], []], "category", "region")
            .agg(F.count(F.lit(1)).alias("n"),
                 (F.count_distinct("_oid") + F.max(F.when(F.col("_oid").isNull(), 1).otherwise(0)))
                 .cast("bigint").alias("returned"),
                 F.grouping_id().alias("gid")))


def returns_breakdown(grouped: DataFrame) -> DataFrame:
    """Report rows 'returns_by_<key>.<value>' from ``returns_grouped``."""
    by_cat = (F.col("gid") == 1) & F.col("category").isNotNull()
    by_reg = (F.col("gid") == 2) & F.col("region").isNotNull()
    key = F.when(by_cat, F.concat(F.lit("returns_by_category."), F.col("category"))) \
        .otherwise(F.concat(F.lit("returns_by_region."), F.col("region")))
    return (grouped.where(by_cat | by_reg)
            .select(F.lit("returns").alias("metric_type"), key.alias("metric"),
                    F.col("n").cast("double").alias("value"), F.lit(None).cast("string").alias("label")))


HEADLINES = {"lead_time": "mean_lead_time", "fill_rate": "mean_fill_rate"}


def metrics_profile(report: DataFrame) -> DataFrame:
    """Entries per family, a breakdown counting as one, and the two headline values."""
    head = F.lit(None).cast("double")
    for family, metric in HEADLINES.items():
        head = F.when((F.col("metric_type") == family) & (F.col("metric") == metric), F.col("value")).otherwise(head)
    return report.groupBy("metric_type").agg(
        F.count_distinct(F.substring_index("metric", ".", 1)).alias("metric_count"), F.max(head).alias("headline"))


def write_summary_report(report: DataFrame, path: str) -> None:
    (report.coalesce(1).write.mode("overwrite")
     .option("header", True).csv(path))


def json_records(df: DataFrame) -> DataFrame:
    """One JSON object a row (column ``record``): dates as yyyy-MM-dd, numbers
    as numbers, +-inf / NaN / NULL as an empty string."""
    values = [(f.name, C.json_value(F.col(f"`{f.name}`"), f.dataType)) for f in df.schema.fields]
    # to_json leaves NULL fields out; they are put in front as empty strings.
    names = F.array_compact(F.array(*[F.when(v.isNull(), F.lit(f'"{n}":""')) for n, v in values]))
    rows = df.select(F.to_json(F.struct(*[v.alias(n) for n, v in values])).alias("_present"),
                     F.array_join(names, ",").alias("_missing"))
    rest = F.when(F.col("_present") == "{}", F.lit("}")).otherwise(F.concat(F.lit(","), F.expr("substring(_present, 2)")))
    return rows.select(F.when(F.col("_missing") == "", F.col("_present")).otherwise(
        F.concat(F.lit("{"), F.col("_missing"), rest)).alias("record"))


def write_json_records(df: DataFrame, path: str) -> None:
    json_records(df).write.mode("overwrite").text(path)


def export_report(orders: DataFrame, inventory: DataFrame, root: str,
                  stamp: str | None = None, fmt: str = "parquet") -> str:
    """Summary, Orders and Inventory datasets under ``report_<timestamp>/``."""
    stamp = stamp or _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d_%H%M%S")
    base = f"{root.rstrip('/')}/report_{stamp}"
    D.export_summary(orders, inventory).coalesce(1).write.mode("overwrite").format(fmt).save(f"{base}/summary")
    orders.write.mode("overwrite").format(fmt).save(f"{base}/orders")
    inventory.write.mode("overwrite").format(fmt).save(f"{base}/inventory")
    return base
