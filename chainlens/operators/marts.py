"""Analytical marts over the star schema.

Faithful marts
--------------
``mart_vendor_performance`` and ``mart_category_performance`` are defined as
``fact_orders LEFT JOIN fact_returns ON order_id``: every line of an order
is repeated once per return of that order, so SUM / AVG see duplicated
lines and return_rate can exceed 1.  That is the defined result and is kept.

The duplication is never materialised.  A line's multiplicity is the number
of return rows of its order (1 when there are none), so the plan is:

1. lines -> partial aggregate per (category, order_id)   [map-side combine]
2. returns -> rows and distinct ids per order_id
3. join (1) and (2) on order_id: both sides are already reduced, one row per
   (category, order) and one per order, so a hot order or product reaches
   the join as a handful of rows, not as a third of all lines
4. weighted sums per category.

Money is summed exactly as DECIMAL; averages of ratios are rounded.

Corrected marts (``*_line_grain``) aggregate orders and returns per category
separately and join the two small per-category results; a return counts for
the category of its own product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlens.functions import columns as C
from chainlens.functions.frames import dim_join, fact_join


def _with_category(facts: DataFrame, dim_products: DataFrame, skew_share: float | None = None,
                   extra: DataFrame | None = None) -> DataFrame:
    """Facts LEFT JOIN products: a product table below the broadcast size is
    broadcast whatever ``skew_share`` says, a larger one is sort-merge joined
    with the products above that share of the facts salted.

    ``extra`` (one row a product) is joined with the products first, so the
    lines meet product_id once."""
    dim = dim_products.select(F.col("product_id").alias("_dim_pid"), "category")
    if extra is not None:
        # A product with extras but no dimension row still brings them.
        dim = dim.join(extra.withColumnRenamed("product_id", "_dim_pid"), "_dim_pid", "full")
    return dim_join(facts, dim, [("product_id", "_dim_pid")], skew_share).drop("_dim_pid")


def _returns_per_order(fact_returns: DataFrame) -> DataFrame:
    """Return rows (join multiplicity) and distinct non-null return ids per
    order.  Grouping by (order, return id) first dedupes ids with a partial
    aggregate; the second step sees at most one row per id."""
    per_id = (fact_returns.where(F.col("order_id").isNotNull())
              .groupBy("order_id", "return_id").agg(F.count(F.lit(1)).alias("_rows")))
    return per_id.groupBy("order_id").agg(
        F.sum("_rows").alias("ret_rows"), F.count("return_id").alias("ret_ids"))


def _wmoney(sum_col: str, mult: Column) -> Column:
    return C.money_round(F.sum(C.weighted(F.col(sum_col), mult)))


def _wavg(sum_col: str, n_col: str, mult: Column) -> Column:
    return F.try_divide(F.sum(F.col(sum_col) * mult).cast("double"),
                        F.sum(F.col(n_col) * mult).cast("double"))


def _per_category_order(lines: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    lead, ov = F.col("lead_time_days"), F.col("order_value")
    aggs = [
        F.sum(C.money("sales")).alias("s_sales"),
        F.sum(C.money("profit")).alias("s_profit"),
        F.sum(lead).alias("s_lead"), F.count(lead).alias("n_lead"),
        F.sum(C.money("order_value")).alias("s_ov"), F.count(ov).alias("n_ov"),
    ] + (extra or [])
    return lines.groupBy("category", "order_id").agg(*aggs)


def _fanout(per_co: DataFrame, fact_returns: DataFrame) -> DataFrame:
    rpo = _returns_per_order(fact_returns)
    return (fact_join(per_co, rpo, "order_id", "left")
            .withColumn("mult", F.coalesce(F.col("ret_rows"), F.lit(1)).cast("bigint"))
            .withColumn("ids", F.coalesce(F.col("ret_ids"), F.lit(0)).cast("bigint")))


def mart_vendor_performance(fact_orders: DataFrame, dim_products: DataFrame,
                            fact_returns: DataFrame, skew_share: float | None = None) -> DataFrame:
    """Per product category: distinct orders, avg lead time, avg order value,
    sales, profit, distinct returns, return rate - over the fan-out join."""
    lines = _with_category(fact_orders, dim_products, skew_share)
    j = _fanout(_per_category_order(lines), fact_returns)
    m = F.col("mult")
    out = j.groupBy("category").agg(
        F.count("order_id").alias("total_orders"),
        C.ratio_round(_wavg("s_lead", "n_lead", m)).alias("avg_lead_time"),
        C.money_round(F.try_divide(F.sum(C.weighted(F.col("s_ov"), m)).cast("double"),
                                   F.sum(F.col("n_ov") * m).cast("double"))).alias("avg_order_value"),
        _wmoney("s_sales", m).alias("total_sales"),
        _wmoney("s_profit", m).alias("total_profit"),
        F.sum("ids").alias("total_returns"),
    )
    return out.withColumn(
        "return_rate",
        C.ratio_round(F.when(F.col("total_orders") > 0,
                             F.col("total_returns") / F.col("total_orders")).otherwise(F.lit(0.0))))


def mart_inventory_analysis(fact_inventory: DataFrame, dim_products: DataFrame, skew_share: float | None = None) -> DataFrame:
    inv = _with_category(fact_inventory, dim_products, skew_share)
    return inv.groupBy("category").agg(
        C.ratio_round(F.avg("stock_level")).alias("avg_stock_level"),
        C.ratio_round(F.avg("daily_demand")).alias("avg_daily_demand"),
        C.ratio_round(F.avg("fill_rate")).alias("avg_fill_rate"),
        C.ratio_round(F.avg("annualized_turnover")).alias("avg_turnover"),
        C.ratio_round(F.avg("days_of_inventory")).alias("avg_days_of_inventory"),
        F.sum(C.bool_to_int("stockout_risk")).cast("bigint").alias("stockout_risk_count"),
        F.count(F.lit(1)).alias("total_records"),
    )


def mart_fulfillment_analytics(fact_orders: DataFrame, dim_products: DataFrame,
                               cycle_time_from_lead: bool = False, skew_share: float | None = None) -> DataFrame:
    """Per (month, category).  ``avg_cycle_time`` is NULL because the cycle
    time column is never loaded; ``cycle_time_from_lead=True`` fills it with
    the lead time (cycle time has the same definition)."""
    lines = _with_category(fact_orders, dim_products, skew_share)
    cyc = F.col("lead_time_days") if cycle_time_from_lead else F.col("order_cycle_time_days")
    # Lines are first reduced to one row an order and customer, so the two
    # distinct counts expand the reduced rows and not every line.
    per = (lines.groupBy(C.month_start("order_date").alias("month"), "category", "order_id", "customer_id")
           .agg(F.sum("lead_time_days").alias("_sl"), F.count("lead_time_days").alias("_nl"),
                F.sum(cyc).alias("_sc"), F.count(cyc).alias("_nc"), F.sum(C.money("sales")).alias("_sales")))
    return per.groupBy("month", "category").agg(
        F.count_distinct("order_id").alias("total_orders"),
        C.ratio_round(F.try_divide(F.sum("_sl").cast("double"), F.sum("_nl"))).alias("avg_lead_time"),
        C.ratio_round(F.try_divide(F.sum("_sc").cast("double"), F.sum("_nc"))).alias("avg_cycle_time"),
        C.money_round(F.sum("_sales")).alias("total_sales"),
        F.count_distinct("customer_id").alias("unique_customers"),
    )


def _inventory_per_product(fact_inventory: DataFrame) -> DataFrame:
    return fact_inventory.groupBy("product_id").agg(
        F.avg("fill_rate").alias("inv_fill_rate"),
        F.avg("annualized_turnover").alias("inv_turnover"))


def mart_category_performance(fact_orders: DataFrame, dim_products: DataFrame,
                              fact_returns: DataFrame, fact_inventory: DataFrame, skew_share: float | None = None) -> DataFrame:
    """Faithful category mart: orders x products x returns (fan-out) x
    per-product inventory averages; averages weighted by joined rows."""
    lines = _with_category(fact_orders, dim_products, skew_share, _inventory_per_product(fact_inventory))
    extra = [F.sum("inv_fill_rate").alias("s_fill"), F.count("inv_fill_rate").alias("n_fill"),
             F.sum("inv_turnover").alias("s_turn"), F.count("inv_turnover").alias("n_turn")]
    j = _fanout(_per_category_order(lines, extra), fact_returns)
    m = F.col("mult")
    return j.groupBy("category").agg(
        F.count("order_id").alias("total_orders"),
        _wmoney("s_sales", m).alias("total_sales"),
        _wmoney("s_profit", m).alias("total_profit"),
        C.ratio_round(_wavg("s_lead", "n_lead", m)).alias("avg_lead_time"),
        C.ratio_round(_wavg("s_fill", "n_fill", m)).alias("avg_fill_rate"),
        C.ratio_round(_wavg("s_turn", "n_turn", m)).alias("avg_turnover"),
        F.sum("ids").alias("total_returns"),
    )


# --- corrected (line-grain) forms ------------------------------------------

def _returns_per_category(fact_returns: DataFrame, dim_products: DataFrame) -> DataFrame:
    r = _with_category(fact_returns.select("product_id", "return_id"), dim_products)
    return r.groupBy("category").agg(F.count_distinct("return_id").alias("total_returns"))


def _join_category(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join two per-category results (one row per category each, NULL
    category matched null-safely)."""
    r = right.withColumnRenamed("category", "_rcat")
    return (left.join(r, left.category.eqNullSafe(r._rcat), "left").drop("_rcat"))


def mart_vendor_performance_line_grain(fact_orders: DataFrame, dim_products: DataFrame,
                                       fact_returns: DataFrame, skew_share: float | None = None) -> DataFrame:
    lines = _with_category(fact_orders, dim_products, skew_share)
    orders = lines.groupBy("category").agg(
        F.count_distinct("order_id").alias("total_orders"),
        C.ratio_round(F.avg("lead_time_days")).alias("avg_lead_time"),
        C.money_round(C.money_avg("order_value")).alias("avg_order_value"),
        C.money_sum("sales").alias("total_sales"),
        C.money_sum("profit").alias("total_profit"),
    )
    out = _join_category(orders, _returns_per_category(fact_returns, dim_products))
    out = out.withColumn("total_returns", F.coalesce(F.col("total_returns"), F.lit(0)).cast("bigint"))
    return out.withColumn(
        "return_rate",
        C.ratio_round(F.when(F.col("total_orders") > 0,
                             F.col("total_returns") / F.col("total_orders")).otherwise(F.lit(0.0))))


def mart_category_performance_line_grain(fact_orders: DataFrame, dim_products: DataFrame,
                                         fact_returns: DataFrame, fact_inventory: DataFrame, skew_share: float | None = None) -> DataFrame:
    lines = _with_category(fact_orders, dim_products, skew_share, _inventory_per_product(fact_inventory))
    orders = lines.groupBy("category").agg(
        F.count_distinct("order_id").alias("total_orders"),
        C.money_sum("sales").alias("total_sales"),
        C.money_sum("profit").alias("total_profit"),
        C.ratio_round(F.avg("lead_time_days")).alias("avg_lead_time"),
        C.ratio_round(F.avg("inv_fill_rate")).alias("avg_fill_rate"),
        C.ratio_round(F.avg("inv_turnover")).alias("avg_turnover"),
    )
    out = _join_category(orders, _returns_per_category(fact_returns, dim_products))
    return out.withColumn("total_returns", F.coalesce(F.col("total_returns"), F.lit(0)).cast("bigint"))
