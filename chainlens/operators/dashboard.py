"""Summary, chart-feeding aggregates, filters, paging and alerts inputs.

All aggregates skip NULL group keys, as a pandas group-by would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlens import settings
from chainlens.functions import columns as C
from chainlens.functions.frames import count_if, one_row_join, union_all
from chainlens.operators.quantiles import describe_distributed


def _non_null(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull())


# --- A-14 .. A-17 analytics summary -----------------------------------------

def analytics_summary(orders: DataFrame, returns: DataFrame, people: DataFrame) -> DataFrame:
    """Row counts of the three tables, total sales and sales per order row.

    The three inputs are tagged and unioned into ONE aggregate."""
    has_sales = "sales" in orders.columns
    sales = F.col("sales").cast("double") if has_sales else F.lit(None).cast("double")
    u = union_all([
        orders.select(F.lit(0).alias("_src"), sales.alias("_sales")),
        returns.select(F.lit(1).alias("_src"), F.lit(None).cast("double").alias("_sales")),
        people.select(F.lit(2).alias("_src"), F.lit(None).cast("double").alias("_sales")),
    ])
    agg = u.agg(
        count_if(F.col("_src") == 0).alias("total_orders"),
        count_if(F.col("_src") == 1).alias("total_returns"),
        count_if(F.col("_src") == 2).alias("total_customers"),
        F.coalesce(C.money_sum("_sales"), F.lit(0.0)).alias("total_sales"),
    )
    return agg.withColumn("avg_order_value",
                          C.ratio_round(C.safe_ratio("total_sales", "total_orders")))


def sales_by(orders: DataFrame, key: str, alias: str | None = None) -> DataFrame:
    return (_non_null(orders, key).groupBy(F.col(key).alias(alias or key))
            .agg(C.money_sum("sales").alias("total_sales")))


def regional_sales(orders: DataFrame) -> DataFrame:
    return sales_by(orders, "region")


def category_sales_total(orders: DataFrame) -> DataFrame:
    return sales_by(orders, "category")


def monthly_sales(orders: DataFrame) -> DataFrame:
    return (_non_null(orders, "order_date")
            .groupBy(C.month_label("order_date").alias("month"))
            .agg(C.money_sum("sales").alias("total_sales")))


# --- A-18 .. A-25, A-31 dashboard aggregates --------------------------------

def kpi_cards(orders: DataFrame, inventory: DataFrame) -> DataFrame:
    """Order rows, total sales, mean lead time (all rows), mean fill rate in
    percent, mean turnover."""
    o = orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        C.money_sum("sales").alias("total_sales"),
        C.ratio_round(F.avg("lead_time_days")).alias("avg_lead_time"))
    i = inventory.agg(
        C.ratio_round(F.avg(C.nan_to_null("fill_rate")) * 100).alias("fill_rate_pct"),
        C.ratio_round(F.avg(C.nan_to_null("annualized_turnover"))).alias("avg_turnover"))
    return one_row_join(o, i)


def export_summary(orders: DataFrame, inventory: DataFrame) -> DataFrame:
    o = orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        C.ratio_round(F.avg("lead_time_days")).alias("avg_lead_time"))
    i = inventory.agg(
        C.ratio_round(F.avg(C.nan_to_null("fill_rate"))).alias("fill_rate"),
        C.ratio_round(F.avg(C.nan_to_null("annualized_turnover"))).alias("inventory_turnover"),
        count_if(F.col("stockout_risk")).alias("products_at_risk"))
    return one_row_join(o, i)


def lead_time_histogram(orders: DataFrame, bins: int = settings.HISTOGRAM_BINS,
                        bin_width: float | None = None, lead_col: str = "lead_time_days") -> DataFrame:
    """Equal-width histogram: width = (max - min) / bins unless given.

    Rows are counted per lead time once; these few counts give the range and
    are then added up by bin.  Bins without rows are not emitted.
    """
    counts = orders.where(F.col(lead_col).isNotNull()).groupBy(F.col(lead_col).cast("double").alias("_x")).agg(
        F.count(F.lit(1)).alias("_c"))
    everything = Window.partitionBy(F.lit(0))  # one row a lead time
    counts = counts.withColumn("_lo", F.min("_x").over(everything)).withColumn("_hi", F.max("_x").over(everything))
    if bin_width is None:
        w = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))).otherwise(F.lit(1.0))
    else:
        w = F.lit(float(bin_width))
    last = F.lit(bins - 1) if bin_width is None else F.lit(2 ** 31 - 1)
    idx = F.least(F.floor((F.col("_x") - F.col("_lo")) / F.col("_w")).cast("int"), last.cast("int"))
    hist = counts.withColumn("_w", w).groupBy(idx.alias("bin_index"), "_lo", "_w").agg(F.sum("_c").alias("orders"))
    return hist.select(
        "bin_index",
        (F.col("_lo") + F.col("bin_index") * F.col("_w")).alias("bin_start"),
        (F.col("_lo") + (F.col("bin_index") + 1) * F.col("_w")).alias("bin_end"),
        "orders")


def inventory_trends(inventory: DataFrame) -> DataFrame:
    return (inventory.where(F.col("date").isNotNull() & F.col("category").isNotNull())
            .groupBy("date", "category")
            .agg(C.ratio_round(F.avg("stock_level")).alias("avg_stock_level"),
                 C.ratio_round(F.avg("daily_demand")).alias("avg_daily_demand")))


def category_sales_chart(orders: DataFrame) -> DataFrame:
    """Sales and NON-distinct order-id count per category."""
    return (_non_null(orders, "category").groupBy("category")
            .agg(C.money_sum("sales").alias("total_sales"),
                 F.count("order_id").alias("order_count")))


def fill_rate_by_category(inventory: DataFrame) -> DataFrame:
    return (_non_null(inventory, "category").groupBy("category")
            .agg(C.ratio_round(F.avg(C.nan_to_null("fill_rate"))).alias("avg_fill_rate")))


def turnover_describe(inventory: DataFrame, col: str = "annualized_turnover", exact: bool = True) -> DataFrame:
    """count, mean, std, min, quartiles, max.  The quartiles are exact and
    computed across the cluster; ``exact=False``: percentile_approx."""
    if exact:
        return describe_distributed(inventory, col)
    t = C.nan_to_null(col)
    return inventory.agg(
        F.count(t).alias("count"), C.ratio_round(F.avg(t)).alias("mean"), C.ratio_round(F.stddev_samp(t)).alias("std"),
        C.ratio_round(F.min(t)).alias("min"),
        *[C.ratio_round(F.percentile_approx(t, p, 100_000)).alias(n) for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))],
        C.ratio_round(F.max(t)).alias("max"))


def monthly_lead_time(orders: DataFrame) -> DataFrame:
    return (_non_null(orders, "order_date")
            .groupBy(C.month_label("order_date").alias("month"))
            .agg(C.ratio_round(F.avg("lead_time_days")).alias("avg_lead_time")))


def lead_time_detail(orders: DataFrame) -> DataFrame:
    lt = F.col("lead_time_days")
    agg = orders.agg(
        C.ratio_round(F.avg(lt)).alias("mean_lead_time"),
        C.ratio_round(F.median(lt)).alias("median_lead_time"),
        C.ratio_round(F.stddev_samp(lt)).alias("std_lead_time"),
        F.count(lt).alias("_n"))
    return agg.where(F.col("_n") > 0).drop("_n")


# --- F-4 .. F-6, S-3, S-5, U-1, W-1 -------------------------------------------

def stockout_risk_rows(inventory: DataFrame) -> DataFrame:
    return inventory.where(F.col("stockout_risk"))


def high_lead_time_orders(orders: DataFrame, days: int = settings.HIGH_LEAD_TIME_DAYS) -> DataFrame:
    return orders.where(F.col("lead_time_days") > days)


def filter_orders(orders: DataFrame, start: str | None = None, end: str | None = None,
                  category: str | None = "All", region: str | None = "All") -> DataFrame:
    """Date range (inclusive) / category / region selection; 'All' or None
    means no filter.  Plain predicates, so they reach the scan."""
    cond = F.lit(True)
    if start:
        cond = cond & (F.col("order_date") >= F.lit(start).cast("date"))
    if end:
        cond = cond & (F.col("order_date") <= F.lit(end).cast("date"))
    if category not in (None, "All"):
        cond = cond & (F.col("category") == category)
    if region not in (None, "All"):
        cond = cond & (F.col("region") == region)
    return orders.where(cond)


def page(df: DataFrame, order_by: list[str], limit: int | None = None,
         offset: int | None = None) -> DataFrame:
    """Offset / limit page over an explicit total order (``order_by`` names a
    key: no two rows are equal in it); 0 or None = unset.

    With a limit Spark plans a per-partition top-(offset+limit) and merges
    the small candidates.  An offset alone leaves unboundedly many rows, which
    Spark would gather in one task; here the row at the offset is found first
    (a top-offset plan) and the rest are the rows after it, sorted across the
    cluster.  For deep pages use ``page_after``, which never scans past rows.
    """
    if offset and not limit:
        last = df.select(*order_by).orderBy(*order_by).limit(offset).orderBy(*[F.desc_nulls_last(c) for c in order_by]).take(1)
        at = [] if not last else list(zip(order_by, last[0]))
        after, same = F.lit(False), F.lit(True)
        for name, value in at:  # NULLs come first
            c = F.col(name)
            after = after | (same & (c.isNotNull() if value is None else c > F.lit(value)))
            same = same & c.eqNullSafe(F.lit(value))
        return df.where(after).orderBy(*order_by) if at else df.limit(0)
    out = df.orderBy(*order_by)
    if offset:
        out = out.offset(offset)
    if limit:
        out = out.limit(limit)
    return out


def page_after(df: DataFrame, order_by: list[str], last: tuple, limit: int) -> DataFrame:
    """Keyset page: rows strictly after ``last`` in ``order_by`` order."""
    cond = F.lit(False)
    eq = F.lit(True)
    for name, value in zip(order_by, last):
        cond = cond | (eq & (F.col(name) > F.lit(value)))
        eq = eq & (F.col(name) == F.lit(value))
    return df.where(cond).orderBy(*order_by).limit(limit)


def filter_bounds(orders: DataFrame) -> DataFrame:
    return orders.agg(F.min("order_date").alias("min_order_date"),
                      F.max("order_date").alias("max_order_date"))


def filter_options(orders: DataFrame, keys: tuple[str, ...] = ("category", "region")) -> DataFrame:
    """'All' plus the distinct values (NULL kept) of each key, from ONE
    grouping-sets aggregate: one set per key and the empty set (which
    supplies the 'All' entries)."""
    cols = [k for k in keys if k in orders.columns]
    n, full = len(cols), (1 << len(cols)) - 1
    g = orders.groupingSets([[k] for k in cols] + [[]], *cols).agg(F.grouping_id().alias("gid"))
    entries = []
    for i, k in enumerate(cols):
        own = full ^ (1 << (n - 1 - i))  # only k is grouped
        entries.append(F.when(F.col("gid") == own, F.struct(
            F.lit(k).alias("option_type"), F.col(k).cast("string").alias("value"))))
        entries.append(F.when(F.col("gid") == full, F.struct(
            F.lit(k).alias("option_type"), F.lit("All").alias("value"))))
    return (g.select(F.explode(F.array(*entries)).alias("o"))
            .where(F.col("o").isNotNull()).select("o.*"))


def low_stock_vs_max(inventory: DataFrame, threshold: float = settings.INVENTORY_ALERT_THRESHOLD,
                     method: str = "aggregate") -> DataFrame:
    """Snapshots whose stock is below ``threshold`` x the product's maximum.

    ``method='window'`` is the direct ``max(...) over (partition by product)``;
    the default ``'aggregate'`` computes the per-product maximum with a
    partial aggregate and joins it back, which keeps a product holding a
    third of all rows from landing in a single task.
    """
    if method == "window":
        from pyspark.sql import Window
        w = Window.partitionBy("product_id")
        j = inventory.withColumn("max_stock_level", F.max("stock_level").over(w))
    else:
        mx = inventory.groupBy("product_id").agg(F.max("stock_level").alias("max_stock_level"))
        j = inventory.join(mx, "product_id")
    return (j.where(F.col("stock_level") < F.lit(threshold) * F.col("max_stock_level"))
            .select("date", "product_id", "category", "stock_level", "max_stock_level"))
