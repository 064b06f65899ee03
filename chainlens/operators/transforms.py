"""Ingest transforms for landed order / returns / people tables.

The reference adds columns only when the inputs exist, so each transform
inspects ``df.columns`` at plan-build time (no data is touched) and adds
the derived columns as plain expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlens.functions import columns as C


def _coerce_dates(df: DataFrame, names: list[str], lenient: bool) -> DataFrame:
    conv = C.to_date_lenient if lenient else C.to_date_strict
    for name in names:
        if name in df.columns and not isinstance(df.schema[name].dataType, T.DateType):
            df = df.withColumn(name, conv(name))
    return df


def normalise_doubles(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every floating column (pandas counts NaN as missing)."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(C.nan_to_null(f.name).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)


def enrich_orders(df: DataFrame, lenient: bool = False) -> DataFrame:
    """Dates coerced; lead time, order year / month / quarter, order value.

    The lead time is the number of whole days elapsed, so where the inputs
    carry a time of day it is taken before they become dates."""
    cols = set(df.columns)
    new: dict = {}
    if {"order_date", "ship_date"} <= cols:
        kinds = [df.schema[c].dataType for c in ("ship_date", "order_date")]
        if all(isinstance(k, T.DateType) for k in kinds):
            lead = C.day_diff("ship_date", "order_date")
        else:
            lead = C.floor_day_diff("ship_date", "order_date", lenient)
        df = df.withColumn("lead_time_days", lead)
    df = _coerce_dates(df, ["order_date", "ship_date"], lenient)
    if "lead_time_days" in df.columns and {"order_date", "ship_date"} <= cols:
        new["lead_time_days"] = F.col("lead_time_days")
    if "order_date" in cols:
        new["order_year"] = F.year("order_date")
        new["order_month"] = F.month("order_date")
        new["order_quarter"] = F.quarter("order_date")
    if {"sales", "quantity"} <= cols:
        new["order_value"] = (F.col("sales") * F.col("quantity")).cast("double")
    elif "sales" in cols:
        new["order_value"] = F.col("sales").cast("double")
    return df.withColumns(new) if new else df


def enrich_returns(df: DataFrame, lenient: bool = False) -> DataFrame:
    """Return date is the order date of the returns row when that exists."""
    df = _coerce_dates(df, ["return_date", "order_date"], lenient)
    if "order_date" in df.columns:
        df = df.withColumn("return_date", F.col("order_date"))
    return df


def enrich_people(df: DataFrame, lenient: bool = False) -> DataFrame:
    return _coerce_dates(df, ["first_order_date", "last_order_date"], lenient)
