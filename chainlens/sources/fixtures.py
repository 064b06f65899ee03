"""Adapter from the TPC-H-like test tables to the canonical tables.

``order_lines``  lineitem x orders x customer x nation x region x part; sales include
                 tax (four decimals), some lines name a product that isn't in ``products``,
                 every seventh customer has no state, the smallest parts have no category
``returns``      lines with l_returnflag = 'R'
``people``       customer x nation x region
``products``     part
``inventory``    per (part, ship day): demand = sum of quantities; the stock is a multiple of
                 p_size that changes from day to day and is zero on some

Lines, customers and snapshots whose parent row is absent are kept (left joins).

Join strategy is left to Catalyst and AQE: tables whose measured size is
below ``spark.sql.autoBroadcastJoinThreshold`` (nation, region and, on small
inputs, part / customer) are broadcast, larger ones are shuffled on their
keys.  No side is forced to broadcast, so nothing that grows with the data
is ever shipped whole to every executor.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.functions import columns as C
from chainlens.functions.frames import dim_join, fact_join, hot_keys, salted_join
from chainlens.operators.transforms import enrich_orders

TPCH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


# Source schemas: given explicitly so a scan needs no footer / inference pass.
TPCH_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": ("p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
             "p_retailprice DOUBLE"),
    "orders": ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
               "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"),
    "lineitem": ("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                 "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                 "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"),
    "events": ("event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
               "props STRING"),
}


# Columns of order lines and returns that come from the customer and part tables.
FROM_CUSTOMER = ["country", "region"]
FROM_PART = ["category", "profit"]


class Raw:
    """Lazily scanned source tables of one scale factor (one reader per table)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._readers: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._readers:
            path = os.path.join(self.sf_dir, f"{name}.parquet")
            reader = self.spark.read
            if name in TPCH_SCHEMAS:
                reader = reader.schema(TPCH_SCHEMAS[name])
            self._readers[name] = reader.parquet(path)
        return self._readers[name]


def raw(spark: SparkSession, sf_dir: str) -> Raw:
    return Raw(spark, sf_dir)


def _geo(r: Raw) -> DataFrame:
    nation = r.table("nation").select("n_nationkey", "n_name", "n_regionkey")
    region = r.table("region").select("r_regionkey", "r_name")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")


def _unique(df: DataFrame, key: str) -> bool:
    """No two rows with one key: a LEFT JOIN to ``df`` keeps the number of rows."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()


def _order_heads(r: Raw, geography: bool = True) -> DataFrame:
    """orders x customer x geography: one row per order (4x fewer rows than
    lineitem, so the customer join runs before the big lineitem join).
    Without ``geography`` its columns are NULL."""
    cust = r.table("customer").select("c_custkey", "c_nationkey")
    cust = cust.join(_geo(r), cust.c_nationkey == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")
    orders = r.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if not geography and _unique(cust, "c_custkey"):
        return orders.selectExpr("*", "CAST(NULL AS STRING) AS n_name", "CAST(NULL AS STRING) AS r_name")
    return fact_join(orders, cust, orders.o_custkey == cust.c_custkey, "left").select(
        "o_orderkey", "o_custkey", "o_orderdate", "n_name", "r_name")


def _lines(r: Raw, returned_only: bool = False, lineitem: DataFrame | None = None,
           skew_share: float | None = None, columns: list[str] | None = None,
           deal: tuple[str, int] | None = None) -> DataFrame:
    """Order lines; ``lineitem`` may be a STREAM of lineitem rows, which is
    then joined to the static order / customer / part tables (stream-static
    join, evaluated per micro-batch).

    ``columns``: those that the caller takes.  A table that gives none of them
    is not joined, unless a key that it has twice makes the join repeat rows.

    ``deal``: a column's name and a number ``n``.  The column deals the orders
    out into ``n`` parts, by which the lines are partitioned; they meet their
    order there, so what works by that column shuffles them no more.

    ``skew_share``: order keys holding at least this share of all lines are
    detected first and spread over several tasks by a salted join."""
    src = lineitem if lineitem is not None else r.table("lineitem")
    li = src.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    if returned_only:
        li = li.where(F.col("l_returnflag") == "R")
    part = r.table("part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    taken = set(columns or FROM_CUSTOMER + FROM_PART)
    heads = _order_heads(r, geography=not taken.isdisjoint(FROM_CUSTOMER))
    no_part = taken.isdisjoint(FROM_PART) and _unique(part, "p_partkey")

    def with_part(lines: DataFrame) -> DataFrame:
        if no_part:
            return lines.selectExpr("*", *[f"CAST(NULL AS {part.schema[c].dataType.simpleString()}) AS {c}" for c in part.columns])
        if src.isStreaming:
            return lines.join(part, lines.l_partkey == part.p_partkey, "left")
        return dim_join(lines, part, [("l_partkey", "p_partkey")], skew_share)

    if deal:
        name, n = deal
        li = with_part(li).withColumn(name, _dealt("l_orderkey", n)).repartition(n, name)
        heads = heads.withColumn("_dealt", _dealt("o_orderkey", n)).repartition(n, "_dealt")
        joined = fact_join(li, heads, (li[name] == heads._dealt) & (li.l_orderkey == heads.o_orderkey), "left")
    elif skew_share and not src.isStreaming:
        hot = hot_keys(li, ["l_orderkey"], skew_share)
        joined = with_part(salted_join(li, heads, [("l_orderkey", "o_orderkey")], "left", hot=hot))
    elif src.isStreaming:
        joined = with_part(li.join(heads, li.l_orderkey == heads.o_orderkey, "left"))
    else:
        joined = with_part(fact_join(li, heads, li.l_orderkey == heads.o_orderkey, "left"))
    return joined.selectExpr(
        "CAST(l_orderkey AS STRING) AS order_id",
        "CAST(o_orderdate AS DATE) AS order_date",
        "CAST(l_shipdate AS DATE) AS ship_date",
        "CAST(o_custkey AS STRING) AS customer_id",
        "IF(l_linenumber = 7 AND l_quantity < 5, concat(l_partkey, 'X'), CAST(l_partkey AS STRING)) AS product_id",
        "CAST(l_suppkey AS STRING) AS supplier_id",
        "CAST(l_linenumber AS INT) AS line_number",
        "IF(p_size > 1, p_type, NULL) AS category",
        "CAST(l_quantity AS BIGINT) AS quantity",
        "l_extendedprice * (1 + l_tax) AS sales",
        "l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice AS profit",
        "l_discount AS discount",
        "n_name AS country",
        "IF(o_custkey % 7 = 0, NULL, concat('ST', o_custkey % 5)) AS state",
        "r_name AS region", *([deal[0]] if deal else []),
    )


def _dealt(key: str, n: int):
    """The part in 0 .. n - 1 of an order, by its id as text."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n))


def order_lines(r: Raw, lineitem: DataFrame | None = None, skew_share: float | None = None,
                columns: list[str] | None = None, deal: tuple[str, int] | None = None) -> DataFrame:
    """Canonical order lines with the ingest-derived columns (a stream when
    ``lineitem`` is a stream; hot order keys salted when ``skew_share``), or
    only ``columns`` of them.  ``deal=("doc", n)``: partitioned by a further
    column ``doc`` that deals the orders out into ``n`` parts."""
    lines = enrich_orders(_lines(r, lineitem=lineitem, skew_share=skew_share, columns=columns, deal=deal))
    return lines.select(*columns) if columns else lines


def returns(r: Raw, skew_share: float | None = None, lineitem: DataFrame | None = None,
            columns: list[str] | None = None) -> DataFrame:
    """Returned lines; return date = order date; stable return id from the
    natural line key (order, part, supplier, line number, ship day).  A stream
    when ``lineitem`` is one.  ``columns``: only these."""
    lines = _lines(r, returned_only=True, lineitem=lineitem, skew_share=skew_share, columns=columns)
    found = lines.select(
        F.col("order_date").alias("return_date"),
        "order_id", "customer_id", "product_id", "category", "region",
        C.stable_id("RET_", "order_id", "product_id", "supplier_id", "line_number", "ship_date").alias("return_id"),
    )
    return found.select(*columns) if columns else found


def people(r: Raw) -> DataFrame:
    cust = r.table("customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return cust.join(_geo(r), cust.c_nationkey == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("r_name").alias("region"),
    )


def products(r: Raw) -> DataFrame:
    return r.table("part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_retailprice").alias("price"),
        F.when(F.col("p_size") > 1, F.col("p_type")).alias("category"),
        F.col("p_brand").alias("description"),
        F.lit(None).cast("string").alias("image"),
    )


def inventory(r: Raw, skew_share: float | None = None) -> DataFrame:
    """Daily product snapshots derived from shipments.

    Aggregating lineitem to (part, day) first uses map-side partial
    aggregation and spreads a hot part over its days; only the reduced rows
    meet the part table.
    """
    demand = (r.table("lineitem")
              .groupBy("l_partkey", F.col("l_shipdate").cast("date").alias("date"))
              .agg(F.sum("l_quantity").cast("bigint").alias("daily_demand")))
    part = r.table("part").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    j = dim_join(demand, part, [("l_partkey", "p_partkey")], skew_share)
    turn = "(dayofyear(date) + l_partkey)"
    stock = f"CAST(IF({turn} % 29 = 0, 0, p_size * (1 + {turn} % 13)) AS BIGINT)"
    return j.selectExpr(
        "date",
        "CAST(l_partkey AS STRING) AS product_id",
        "p_name AS product_name",
        "IF(p_size > 1, p_type, NULL) AS category",
        f"{stock} AS stock_level",
        "daily_demand",
        "CAST(0 AS BIGINT) AS restock_amount",
        "false AS restocked",
        "p_retailprice AS price",
        "p_retailprice AS original_price",
        "CAST(0 AS DOUBLE) AS price_change_pct",
        f"try_divide({stock}, daily_demand) AS days_of_inventory",
        f"{stock} < daily_demand AS stockout_risk",
        f"try_divide(daily_demand * 365, {stock}) AS annualized_turnover",
        f"least(CAST(1 AS DOUBLE), try_divide({stock}, daily_demand)) AS fill_rate",
    )


def events(r: Raw) -> DataFrame:
    return r.table("events")


class Tables:
    """The canonical tables of one input, each built on first use.

    ``skew_share``: salt order keys that hold at least this share of all
    lines in the lineitem-orders join (off by default)."""

    def __init__(self, r: Raw, skew_share: float | None = None):
        self.raw = r
        self.skew_share = skew_share

    @cached_property
    def orders(self) -> DataFrame:
        return order_lines(self.raw, skew_share=self.skew_share)

    @cached_property
    def returns(self) -> DataFrame:
        return returns(self.raw, skew_share=self.skew_share)

    @cached_property
    def people(self) -> DataFrame:
        return people(self.raw)

    @cached_property
    def products(self) -> DataFrame:
        return products(self.raw)

    @cached_property
    def inventory(self) -> DataFrame:
        return inventory(self.raw, self.skew_share)


def tables(spark: SparkSession, sf_dir: str, skew_share: float | None = None) -> Tables:
    return Tables(raw(spark, sf_dir), skew_share)
