"""Data-quality checks and alerts.

Every check is one aggregate pass over its table; schema checks are
decided at plan time and attached to a row count of the table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlens import settings
from chainlens.functions import columns as C
from chainlens.functions.frames import count_if, union_all
from chainlens.schemas import CANONICAL_TO_SHEET, REQUIRED_FIELDS, SHEET_HEADERS


def _is_missing(f: T.StructField) -> Column:
    c = F.col(f.name)
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def null_cells(df: DataFrame) -> Column:
    """Number of NULL (or NaN) cells of a row, summed over all columns."""
    terms = [F.when(_is_missing(f), F.lit(1)).otherwise(F.lit(0)) for f in df.schema.fields]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def missing_share(df: DataFrame, table_name: str,
                  threshold: float = settings.MISSING_DATA_ALERT_THRESHOLD) -> DataFrame:
    """Missing cells / (rows x columns) for the whole table.  WARNING when
    strictly above the threshold, PASS otherwise (also for an empty table,
    whose share is NULL)."""
    ncols = len(df.columns)
    agg = df.agg(F.sum(null_cells(df)).cast("bigint").alias("null_cells"),
                 F.count(F.lit(1)).alias("row_count"))
    total = (F.col("row_count") * F.lit(ncols)).cast("bigint")
    share = C.ratio_round(F.try_divide(F.col("null_cells").cast("double"), total.cast("double")))
    return agg.select(
        F.lit(table_name).alias("table_name"),
        F.coalesce(F.col("null_cells"), F.lit(0)).cast("bigint").alias("null_cells"),
        total.alias("total_cells"),
        share.alias("missing_share"),
        F.when(share > F.lit(threshold), F.lit("WARNING")).otherwise(F.lit("PASS")).alias("status"))


def dq_missing_cells(tables: Mapping[str, DataFrame]) -> DataFrame:
    return union_all([missing_share(df, name) for name, df in tables.items()])


def required_columns(df: DataFrame, checks: Mapping[str, list[str]]) -> DataFrame:
    """FAIL with the missing names when a required column is absent (decided
    from the schema at plan time); the pipeline is never stopped by it.
    One row per check, all attached to a single row count of the table."""
    present = set(df.columns)
    rows = []
    for name, required in checks.items():
        missing = [CANONICAL_TO_SHEET.get(c, c) for c in required if c not in present]
        rows.append(F.struct(F.lit(name).alias("table_name"),
                             F.lit("FAIL" if missing else "PASS").alias("status"),
                             F.lit(", ".join(missing)).alias("missing_columns"),
                             F.col("_rows").alias("rows_checked")))
    return (df.agg(F.count(F.lit(1)).alias("_rows"))
            .select(F.explode(F.array(*rows)).alias("c")).select("c.*"))


SHEET_REQUIRED = [SHEET_HEADERS[c] for c in settings.REQUIRED_ORDER_COLUMNS_SHEET]
API_REQUIRED = [SHEET_HEADERS[c] for c in settings.REQUIRED_ORDER_COLUMNS_API]


def dq_required_columns(orders: DataFrame) -> DataFrame:
    return required_columns(orders, {"orders_sheet": SHEET_REQUIRED, "orders_api": API_REQUIRED})


def required_nulls(df: DataFrame, table_name: str, required: list[str] | None = None) -> DataFrame:
    """NULL count per required (non-null) warehouse column: Parquet tables
    do not enforce NOT NULL, so it is measured.  One aggregate per table."""
    cols = [c for c in (required or REQUIRED_FIELDS[table_name]) if c in df.columns]
    agg = df.agg(*[count_if(F.col(c).isNull()).alias(c) for c in cols])
    stacked = agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in cols])).alias("s"))
    return stacked.select(F.lit(table_name).alias("table_name"), "s.column_name", "s.null_count")


def dq_required_nulls(facts: Mapping[str, DataFrame]) -> DataFrame:
    return union_all([required_nulls(df, name) for name, df in facts.items()])


def table_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    return union_all([
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count",
            F.lit(len(df.columns)).cast("bigint").alias("column_count"))
        for name, df in tables.items()])


def alerts(orders: DataFrame, inventory: DataFrame,
           missing_threshold: float = settings.MISSING_DATA_ALERT_THRESHOLD,
           lead_days: int = settings.HIGH_LEAD_TIME_DAYS) -> DataFrame:
    """Alert rows (alert, value); no rows = all normal.

    stockout      number of snapshot rows at risk, if > 0
    missing_data  missing share of the order table, if > threshold
    high_lead     number of order rows with lead time > 14 days, if > 0
    """
    inv = inventory.agg(count_if(F.col("stockout_risk")).alias("v")).select(
        F.lit("stockout").alias("alert"), F.col("v").cast("double").alias("value"))
    # one pass over the order table for both order alerts
    ncols = len(orders.columns)
    has_lead = "lead_time_days" in orders.columns
    o = orders.agg(
        F.sum(null_cells(orders)).cast("double").alias("_nulls"),
        (F.count(F.lit(1)) * F.lit(ncols)).cast("double").alias("_cells"),
        (count_if(F.col("lead_time_days") > lead_days) if has_lead else F.lit(0).cast("bigint")).alias("_long"))
    share = C.ratio_round(F.try_divide(F.col("_nulls"), F.col("_cells")))
    order_alerts = [F.when(share > F.lit(missing_threshold), F.struct(
        F.lit("missing_data").alias("alert"), share.alias("value")))]
    if has_lead:
        order_alerts.append(F.when(F.col("_long") > 0, F.struct(
            F.lit("high_lead_time").alias("alert"), F.col("_long").cast("double").alias("value"))))
    o_rows = o.select(F.explode(F.array(*order_alerts)).alias("a")).where(F.col("a").isNotNull()).select("a.*")
    return inv.where(F.col("value") > 0).unionByName(o_rows)


def observe_required_nulls(df: DataFrame, table_name: str, required: list[str] | None = None):
    """Attach NULL counts of the required columns to a DataFrame that is
    about to be written: the counts are gathered by the write job itself
    (no extra pass).  Returns (observed_df, observation); read
    ``observation.get`` after the action."""
    from pyspark.sql import Observation
    cols = [c for c in (required or REQUIRED_FIELDS[table_name]) if c in df.columns]
    obs = Observation(f"required_nulls_{table_name}")
    observed = df.observe(obs, *[count_if(F.col(c).isNull()).alias(c) for c in cols])
    return observed, obs
