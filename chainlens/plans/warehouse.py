"""Star schema: DDL, dimension / fact builders and loads.

Builders are pure DataFrame transforms (select / rename / derive).  Loads
write Parquet catalog tables with ``mode('overwrite')``; fact tables are
partitioned by day and clustered by sorting within partitions, which gives
row-group min/max skipping on the clustering keys.

Before a partitioned write the rows are shuffled with a REBALANCE hint on
the partition column: AQE then coalesces small days into one task and splits
a large (or skewed) day into tasks of ``advisoryPartitionSizeInBytes``, so
each day is written as a few files of useful size and a day holding a third
of all rows is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlens.functions import columns as C
from chainlens.schemas import WAREHOUSE_DDL

AUDIT = ["created_date", "updated_date"]


# --- DDL --------------------------------------------------------------------

def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}{loc}")


def create_star_schema(spark: SparkSession, database: str) -> list[str]:
    """Create the 7 tables if absent (Parquet, day-partitioned facts)."""
    made = []
    for table, (cols, part, _cluster) in WAREHOUSE_DDL.items():
        part_sql = f" PARTITIONED BY ({part})" if part else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{table} ({cols}) USING parquet{part_sql}")
        made.append(table)
    return made


# --- builders ---------------------------------------------------------------

def dim_products(products: DataFrame) -> DataFrame:
    return products.select(
        F.col("id").cast("string").alias("product_id"),
        F.col("title").alias("product_name"),
        "category", F.col("price").cast("double").alias("price"),
        "description", F.col("image").alias("image_url"))


def fact_orders(orders: DataFrame, keep: list[str] = ()) -> DataFrame:
    """location_id = country || '_' || state when both columns exist,
    'Unknown' otherwise.  delivery_date, shipping_cost and
    order_cycle_time_days are declared but not loaded (typed NULL).  ``keep``
    names further input columns to carry."""
    cols = set(orders.columns)
    loc = C.location_id("country", "state") if {"country", "state"} <= cols else F.lit("Unknown")
    return orders.select(
        "order_id", "order_date", "ship_date",
        F.lit(None).cast("date").alias("delivery_date"),
        "customer_id", F.col("product_id").cast("string").alias("product_id"),
        loc.alias("location_id"),
        "quantity", "sales", "profit", "discount",
        F.lit(None).cast("double").alias("shipping_cost"),
        F.col("lead_time_days").cast("bigint").alias("lead_time_days"),
        F.lit(None).cast("bigint").alias("order_cycle_time_days"),
        "order_value", *keep)


def fact_inventory(inventory: DataFrame) -> DataFrame:
    return inventory.select(
        C.inventory_id("product_id", "date").alias("inventory_id"),
        "date", F.col("product_id").cast("string").alias("product_id"),
        "stock_level", "daily_demand", "restock_amount", "restocked", "price",
        "original_price", "price_change_pct", "days_of_inventory", "stockout_risk",
        "annualized_turnover", "fill_rate")


def fact_returns(returns: DataFrame) -> DataFrame:
    """return_id is kept when the input carries one; otherwise it is derived
    from the row's own values (a row index means nothing on a distributed
    frame), with an ordinal from the second of equal rows on.  return_reason
    / return_amount are declared, not loaded."""
    if "return_id" in returns.columns:
        rid = F.col("return_id")
    else:
        values = [F.col(f"`{c}`") for c in returns.columns]
        nth = F.row_number().over(Window.partitionBy(*values).orderBy(F.lit(1)))
        returns = returns.withColumn("_nth", nth)
        rid = F.concat(C.stable_id("RET_", *values), F.when(F.col("_nth") > 1, F.concat(F.lit("_"), "_nth")).otherwise(""))
    return returns.select(
        rid.alias("return_id"), "return_date", "order_id", "customer_id",
        F.col("product_id").cast("string").alias("product_id"),
        F.lit(None).cast("string").alias("return_reason"),
        F.lit(None).cast("double").alias("return_amount"))


def _reduced(rows: DataFrame) -> DataFrame:
    """Distinct rows by a hash aggregate of their own.  The maxima of text and
    structs that follow sort their input, so they should meet few rows; a
    plain ``distinct`` below a maximum is optimised away, a used count isn't."""
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0").drop("_n")


def dim_customers(people: DataFrame, orders: DataFrame) -> DataFrame:
    """People with one address each: the address of the customer's latest
    order line (ties broken by order id, then the address itself).
    Lines are first reduced to the distinct (customer, order, address) by a
    hash aggregate, so only those few rows are sorted for the maximum."""
    cols = set(orders.columns)
    country = F.col("country") if "country" in cols else F.lit(None).cast("string")
    state = F.col("state") if "state" in cols else F.lit(None).cast("string")
    lines = orders.where(F.col("customer_id").isNotNull()).select(
        "customer_id", "order_date", "order_id", country.alias("a_country"), state.alias("a_state"))
    lines = _reduced(lines)
    addr = lines.groupBy("customer_id").agg(F.max(F.struct("order_date", "order_id", "a_country", "a_state")).alias("addr"))
    j = people.join(addr, "customer_id", "left")
    return j.select(
        "customer_id", "customer_name", "segment",
        F.col("addr.a_country").alias("country"),
        F.lit(None).cast("string").alias("city"),
        F.col("addr.a_state").alias("state"),
        F.lit(None).cast("string").alias("postal_code"),
        "region")


def dim_time(orders: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """One row per calendar day between the first and last order / ship day.

    The day list is generated from a one-row min/max aggregate, so its size
    is bounded by the calendar span (36,525 rows per century), not by the
    data volume.  day_of_week: 1 = Sunday .. 7 = Saturday.
    """
    bounds = orders.agg(
        F.least(F.min("order_date"), F.min("ship_date")).alias("lo"),
        F.greatest(F.max("order_date"), F.max("ship_date")).alias("hi"))
    days = bounds.where(F.col("lo").isNotNull()).select(
        F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("date_id"))
    dow = F.dayofweek("date_id")
    out = days.select(
        "date_id",
        F.year("date_id").alias("year"), F.month("date_id").alias("month"),
        F.dayofmonth("date_id").alias("day"), F.quarter("date_id").alias("quarter"),
        dow.alias("day_of_week"), dow.isin(1, 7).alias("is_weekend"))
    if holidays is None:
        return out.withColumn("is_holiday", F.lit(False))
    h = holidays.select(F.col("date").cast("date").alias("_hday")).distinct()
    return (out.join(h, out.date_id == h._hday, "left")
            .withColumn("is_holiday", F.col("_hday").isNotNull()).drop("_hday"))


def dim_locations(orders: DataFrame) -> DataFrame:
    """One row per location_id (same rule as fact_orders)."""
    cols = set(orders.columns)
    loc = C.location_id("country", "state") if {"country", "state"} <= cols else F.lit("Unknown")
    state = F.col("state") if "state" in cols else F.lit(None).cast("string")
    region = F.col("region") if "region" in cols else F.lit(None).cast("string")
    country = F.col("country") if "country" in cols else F.lit(None).cast("string")
    rows = orders.select(loc.alias("location_id"), country.alias("country"), state.alias("state"),
                         region.alias("region"))
    rows = _reduced(rows)
    return (rows.where(F.col("location_id").isNotNull())
            .groupBy("location_id")
            .agg(F.min("country").alias("country"), F.min("state").alias("state"),
                 F.min("region").alias("region"))
            .select("location_id", "country", "state",
                    F.lit(None).cast("string").alias("city"),
                    F.lit(None).cast("string").alias("postal_code"), "region"))


def with_audit(df: DataFrame) -> DataFrame:
    now = F.current_timestamp()
    return df.withColumn("created_date", now).withColumn("updated_date", now)


# --- loads ------------------------------------------------------------------

def write_table(df: DataFrame, name: str, partition_col: str | None = None,
                cluster_cols: list[str] | None = None, path: str | None = None,
                mode: str = "overwrite", grain: str = "day") -> None:
    """Overwrite-load a table (catalog name, or a path when ``path`` given).

    ``grain='month'`` partitions by a derived ``<col>_month`` (first day of
    the month) instead of the day itself: 30x fewer directories for small
    daily volumes; the day column stays in the rows (filter on both for
    pruning)."""
    if partition_col and grain == "month":
        month_col = f"{partition_col}_month"
        df = df.withColumn(month_col, C.month_start(partition_col))
        cluster_cols = [partition_col] + list(cluster_cols or [])
        partition_col = month_col
    if partition_col:
        df = df.hint("rebalance", partition_col)
    if cluster_cols:
        df = df.sortWithinPartitions(*([partition_col] if partition_col else []), *cluster_cols)
    w = df.write.mode(mode).format("parquet")
    if partition_col:
        w = w.partitionBy(partition_col)
    if path:
        w.save(path)
    else:
        w.saveAsTable(name)


def dimension_and_fact_frames(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The warehouse tables that the given inputs (products / orders /
    inventory / returns / people) allow, dimensions first."""
    out: dict[str, DataFrame] = {}
    if "products" in tables:
        out["dim_products"] = dim_products(tables["products"])
    if "people" in tables and "orders" in tables:
        out["dim_customers"] = dim_customers(tables["people"], tables["orders"])
    if "orders" in tables:
        out["dim_time"] = dim_time(tables["orders"])
        out["dim_locations"] = dim_locations(tables["orders"])
        out["fact_orders"] = fact_orders(tables["orders"])
    if "inventory" in tables:
        out["fact_inventory"] = fact_inventory(tables["inventory"])
    if "returns" in tables:
        out["fact_returns"] = fact_returns(tables["returns"])
    return out


def insert_table(df: DataFrame, name: str, partition_col: str | None, cluster_cols: list[str]) -> None:
    """Overwrite the rows of a declared table, keeping its columns and types."""
    fields = df.sparkSession.table(name).schema.fields
    present = set(df.columns)
    if partition_col:
        df = df.hint("rebalance", partition_col)
    df = df.sortWithinPartitions(*([partition_col] if partition_col else []), *cluster_cols)
    df.select(*[(F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in fields]).write.insertInto(name, overwrite=True)


def load_warehouse(tables: dict[str, DataFrame], database: str | None = None,
                   root: str | None = None, audit: bool = True, grain: str = "day") -> list[str]:
    """Load whichever inputs are present, dimensions first: into the declared
    tables of ``database`` (created if absent), or as folders under ``root``."""
    plan = dimension_and_fact_frames(tables)
    if database and plan:
        spark = next(iter(plan.values())).sparkSession
        create_database(spark, database)
        create_star_schema(spark, database)
    for name, df in plan.items():
        _cols, part, cluster = WAREHOUSE_DDL[name]
        out = with_audit(df) if audit and name != "dim_time" else df
        if database:
            insert_table(out, f"{database}.{name}", part, cluster)
        else:
            write_table(out, name, part, cluster, path=f"{root}/{name}", grain=grain)
    return list(plan)


NOT_FOUND = {"PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"}


def read_warehouse(spark: SparkSession, database: str | None = None,
                   root: str | None = None) -> dict[str, DataFrame]:
    """The tables that exist.  Anything but an absent table is an error, and
    so is a warehouse without any."""
    out = {}
    for name in WAREHOUSE_DDL:
        try:
            out[name] = spark.table(f"{database}.{name}") if database else spark.read.parquet(f"{root}/{name}")
        except AnalysisException as e:
            if e.getCondition() not in NOT_FOUND:
                raise
    if not out:
        raise FileNotFoundError(f"no warehouse table in {database or root}")
    return out
