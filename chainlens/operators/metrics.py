"""The six metric families and the category / returns breakdowns.

Each family is ONE global (or per-category) aggregate over its input, so a
family costs one scan and, for grouped forms, one shuffle of partial
aggregates.  Spark's exact ``percentile`` merges a value -> count map in one
task, so it is used for whole-day lead times only, whose number of distinct
values is bounded by the calendar.  The medians of ratios (turnover, days of
inventory, fill rate) come from ``operators.quantiles``, which is exact and
spread over the cluster, and enter the aggregate as literals
(``exact=False``: ``percentile_approx`` in the same pass).

Counting conventions (they differ on purpose):
* ``total_orders`` of the lead-time family is a count of valid ROWS;
* ``total_orders`` of the returns family is the number of order ROWS;
* distinct order counts appear only in the category breakdown.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlens import settings
from chainlens.functions import columns as C
from chainlens.functions.frames import count_if, nonempty
from chainlens.operators.quantiles import exact_median, grouped_percentiles


def _median(c: Column, exact: bool) -> Column:
    return F.median(c) if exact else F.percentile_approx(c, 0.5, 100_000)


def _pct(c: Column, q: float, exact: bool) -> Column:
    return F.percentile(c, q) if exact else F.percentile_approx(c, q, 100_000)


# Each family is a list of aliased aggregate expressions plus the name of
# the column that counts its input rows.  A family can be evaluated alone
# (``_family_frame``) or merged with others into ONE aggregate pass over the
# same table (the summary report does that).

def lead_time_exprs(lead: Column, exact: bool = True) -> tuple[dict[str, Column], str]:
    """Lead-time family over valid rows (0 <= days <= 30).

    Bands: excellent d <= 3, good 3 < d <= 7, poor d > 7.
    ``invalid_lead_times`` = all rows - valid rows (NULL lead time is invalid).
    """
    valid = C.valid_lead_time(lead)
    v = F.when(valid, lead)
    th = settings.LEAD_TIME_THRESHOLDS
    return {
        "mean_lead_time": C.ratio_round(F.avg(v)),
        "median_lead_time": C.ratio_round(_median(v, exact)),
        "std_lead_time": C.ratio_round(F.stddev_samp(v)),
        "min_lead_time": F.min(v).cast("double"),
        "max_lead_time": F.max(v).cast("double"),
        "lead_time_95th_percentile": C.ratio_round(_pct(v, 0.95, exact)),
        "excellent_pct": C.share(F.when(valid, v <= th["excellent"])),
        "good_pct": C.share(F.when(valid, (v > th["excellent"]) & (v <= th["good"]))),
        "poor_pct": C.share(F.when(valid, v > th["good"])),
        "total_orders": F.count(v),
        "invalid_lead_times": (F.count(F.lit(1)) - F.count(v)),
    }, "total_orders"


def cycle_time_exprs(exact: bool = True) -> tuple[dict[str, Column], str]:
    """Cycle time = ship date - order date over the same 0..30 window."""
    ct = C.day_diff("ship_date", "order_date")
    v = F.when(C.valid_lead_time(ct), ct)
    return {
        "mean_cycle_time": C.ratio_round(F.avg(v)),
        "median_cycle_time": C.ratio_round(_median(v, exact)),
        "std_cycle_time": C.ratio_round(F.stddev_samp(v)),
        "min_cycle_time": F.min(v).cast("double"),
        "max_cycle_time": F.max(v).cast("double"),
        "cycle_time_95th_percentile": C.ratio_round(_pct(v, 0.95, exact)),
        "total_orders": F.count(v),
    }, "total_orders"


TURNOVER, FILL_RATE = "annualized_turnover", "fill_rate"


def days_of_inventory() -> Column:
    """stock_level / daily_demand over rows with both > 0."""
    ok = (F.col("stock_level") > 0) & (F.col("daily_demand") > 0)
    return F.when(ok, C.nan_to_null(F.try_divide(F.col("stock_level").cast("double"), F.col("daily_demand").cast("double"))))


def _own_median(inventory: DataFrame, col: str | Column, exact: bool) -> Column:
    return exact_median(inventory, col) if exact else F.percentile_approx(C.nan_to_null(col), 0.5, 100_000)


def ratio_percentiles_by(inventory: DataFrame, by: str, qs: tuple[float, ...] = (0.25, 0.5, 0.95)) -> DataFrame:
    """Exact quantiles of turnover, days of inventory and fill rate per value of ``by``, all from one
    read: (``by``, metric, p25, p50, p95).  The values of ``by`` must be few."""
    out = grouped_percentiles(inventory, {"turnover": TURNOVER, "days_of_inventory": days_of_inventory(),
                                          "fill_rate": FILL_RATE}, list(qs), by)
    return out.select(by, F.col("name").alias("metric"), *[C.ratio_round(F.col(c)).alias(c) for c in out.columns[2:]])


def turnover_exprs(median: Column) -> tuple[dict[str, Column], str]:
    t = C.nan_to_null(TURNOVER)
    return {
        "mean_turnover": C.ratio_round(F.avg(t)),
        "median_turnover": C.ratio_round(median),
        "std_turnover": C.ratio_round(F.stddev_samp(t)),
        "min_turnover": C.ratio_round(F.min(t)),
        "max_turnover": C.ratio_round(F.max(t)),
        "_n_turnover": F.count(t),
    }, "_n_turnover"


def days_of_inventory_exprs(median: Column) -> tuple[dict[str, Column], str]:
    d = days_of_inventory()
    return {
        "mean_days_of_inventory": C.ratio_round(F.avg(d)),
        "median_days_of_inventory": C.ratio_round(median),
        "std_days_of_inventory": C.ratio_round(F.stddev_samp(d)),
        "_n_days": F.count(d),
    }, "_n_days"


def fill_rate_exprs(median: Column) -> tuple[dict[str, Column], str]:
    """Bands: excellent >= 0.95, good 0.85 <= x < 0.95, poor < 0.85."""
    fr = C.nan_to_null(FILL_RATE)
    th = settings.FILL_RATE_THRESHOLDS
    return {
        "mean_fill_rate": C.ratio_round(F.avg(fr)),
        "median_fill_rate": C.ratio_round(median),
        "std_fill_rate": C.ratio_round(F.stddev_samp(fr)),
        "excellent_fill_rate_pct": C.share(fr >= th["excellent"]),
        "good_fill_rate_pct": C.share((fr >= th["good"]) & (fr < th["excellent"])),
        "poor_fill_rate_pct": C.share(fr < th["good"]),
        "_n_fill": F.count(fr),
    }, "_n_fill"


def stockout_exprs() -> tuple[dict[str, Column], str]:
    """products_at_risk counts snapshot ROWS flagged at risk."""
    risk = F.col("stockout_risk")
    return {
        "products_at_risk": count_if(risk),
        "total_products": F.count(F.lit(1)),
        "risk_percentage": C.share(risk),
    }, "total_products"


def _family_frame(df: DataFrame, family: tuple[dict[str, Column], str]) -> DataFrame:
    exprs, n = family
    out = nonempty(df.agg(*[c.alias(k) for k, c in exprs.items()]), n)
    return out.drop(n) if n.startswith("_") else out


def lead_time_metrics(orders: DataFrame, lead_col: str = "lead_time_days", exact: bool = True) -> DataFrame:
    lead = F.col(lead_col) if lead_col in orders.columns else C.day_diff("ship_date", "order_date")
    return _family_frame(orders, lead_time_exprs(lead, exact))


def order_cycle_time_metrics(orders: DataFrame, exact: bool = True) -> DataFrame:
    return _family_frame(orders, cycle_time_exprs(exact))


def lead_time_bands(orders: DataFrame, lead_col: str = "lead_time_days") -> DataFrame:
    """Row counts per band over valid lead times."""
    lt = F.col(lead_col)
    return (orders.where(C.valid_lead_time(lt))
            .groupBy(C.lead_time_band(lt).alias("band"))
            .agg(F.count(F.lit(1)).alias("orders")))


def inventory_turnover_metrics(inventory: DataFrame, exact: bool = True) -> DataFrame:
    return _family_frame(inventory, turnover_exprs(_own_median(inventory, TURNOVER, exact)))


def days_of_inventory_metrics(inventory: DataFrame, exact: bool = True) -> DataFrame:
    return _family_frame(inventory, days_of_inventory_exprs(_own_median(inventory, days_of_inventory(), exact)))


def fill_rate_metrics(inventory: DataFrame, exact: bool = True) -> DataFrame:
    return _family_frame(inventory, fill_rate_exprs(_own_median(inventory, FILL_RATE, exact)))


def stockout_risk_metrics(inventory: DataFrame) -> DataFrame:
    return _family_frame(inventory, stockout_exprs())


# --- A-7 .. A-9, S-1, S-2 category breakdown ----------------------------------

def _category_rows(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("category").isNotNull())


def category_sales(orders: DataFrame) -> DataFrame:
    """Per category: total / mean / count of sales, distinct orders (2 dp)."""
    return _category_rows(orders).groupBy("category").agg(*_sales_aggs())


def _sales_aggs() -> list[Column]:
    return [
        F.bround(C.money_sum("sales"), 2).alias("total_sales"),
        F.bround(C.money_avg("sales"), 2).alias("avg_sale"),
        F.count("sales").alias("total_items"),
        F.count_distinct("order_id").alias("unique_orders"),
    ]


def _lead_aggs(lead_col: str) -> list[Column]:
    lt = F.col(lead_col)
    return [
        F.bround(F.avg(lt), 2).alias("avg_lead_time"),
        F.bround(F.median(lt), 2).alias("median_lead_time"),
        F.bround(F.stddev_samp(lt), 2).alias("std_lead_time"),
        F.count(lt).alias("order_count"),
    ]


def category_lead_time(orders: DataFrame, lead_col: str = "lead_time_days") -> DataFrame:
    """Per category lead time over ALL rows (not limited to 0..30)."""
    return _category_rows(orders).groupBy("category").agg(*_lead_aggs(lead_col))


def category_performance(orders: DataFrame, lead_col: str = "lead_time_days") -> DataFrame:
    """Sales and lead-time breakdown in one pass: both sides group the same
    rows by the same key, so the inner join of the two reduces to a single
    groupBy (one shuffle instead of two plus a join)."""
    aggs = _sales_aggs()
    if lead_col in orders.columns:
        aggs += _lead_aggs(lead_col)
    return _category_rows(orders).groupBy("category").agg(*aggs)


def top_sales_category(orders: DataFrame) -> DataFrame:
    """Category with the highest rounded total (ties: first category)."""
    perf = category_sales(orders)
    return (perf.orderBy(F.col("total_sales").desc(), F.col("category").asc())
            .limit(1)
            .select("category", "total_sales", F.col("unique_orders").alias("order_count")))


def best_lead_time_category(orders: DataFrame, lead_col: str = "lead_time_days") -> DataFrame:
    perf = category_lead_time(orders, lead_col).where(F.col("avg_lead_time").isNotNull())
    return (perf.orderBy(F.col("avg_lead_time").asc(), F.col("category").asc())
            .limit(1)
            .select("category", "avg_lead_time", "order_count"))


# --- A-10 .. A-13 returns -----------------------------------------------------

def return_metrics(orders: DataFrame, returns: DataFrame) -> DataFrame:
    """Distinct returned orders / order ROWS.

    Both inputs are reduced in a single aggregate over their union (no join):
    the order side contributes its row count, the returns side its rows and
    distinct order ids.  A NULL order id counts as one distinct value, as a
    unique-values listing would.
    """
    o = orders.select(F.lit(True).alias("_is_order"), F.lit(None).cast("string").alias("_oid"))
    r = returns.select(F.lit(False).alias("_is_order"), F.col("order_id").cast("string").alias("_oid"))
    u = o.unionByName(r)
    is_ret = ~F.col("_is_order")
    returned = (F.count_distinct(F.when(is_ret, F.col("_oid")))
                + F.max(F.when(is_ret & F.col("_oid").isNull(), 1).otherwise(0)))
    agg = u.agg(
        count_if(F.col("_is_order")).alias("total_orders"),
        returned.cast("bigint").alias("total_returned_orders"),
        count_if(is_ret).alias("total_return_items"),
    )
    agg = agg.withColumn("return_rate", C.ratio_round(C.safe_ratio("total_returned_orders", "total_orders")))
    return nonempty(agg, "total_orders").select(
        "return_rate", "total_orders", "total_returned_orders", "total_return_items")


def returns_by(returns: DataFrame, key: str) -> DataFrame:
    """Frequency-ordered value counts, NULL keys dropped."""
    return (returns.where(F.col(key).isNotNull())
            .groupBy(key).agg(F.count(F.lit(1)).alias("return_count"))
            .orderBy(F.col("return_count").desc(), F.col(key).asc()))


def expected_returns_by_category(orders: DataFrame, rates: Mapping[str, float] | None = None,
                                 default: float | None = None) -> DataFrame:
    """Expected returns per category: sum of per-line return probabilities
    (category rate, default rate for unlisted categories)."""
    p = C.rate_lookup("category", rates, default)
    return (orders.where(F.col("category").isNotNull())
            .groupBy("category")
            .agg(F.count(F.lit(1)).alias("order_lines"),
                 C.ratio_round(F.sum(p)).alias("expected_returns"),
                 C.ratio_round(F.avg(p)).alias("expected_return_rate")))


LINE_KEY = ["order_id", "product_id", "supplier_id", "line_number", "ship_date"]


def stratified_return_sample(orders: DataFrame, seed: int = 42,
                             rates: Mapping[str, float] | None = None,
                             default: float | None = None,
                             key: list[str] | None = None) -> DataFrame:
    """Deterministic stratified sample of order lines: each category at its rate.

    A line is drawn when unit_hash(line key, seed) < rate(category).  The draw
    is a per-row expression, so it needs no shuffle and gives the same rows on
    any partitioning.
    """
    key = key or [k for k in LINE_KEY if k in orders.columns]
    p = C.rate_lookup(F.coalesce(F.col("category"), F.lit("")), rates, default)
    return orders.where(C.unit_hash(*key, seed=seed) < p)
