"""Column expressions shared by the operators.

All of them are built-in Catalyst expressions, so they stay inside
whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlens import settings


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- dates ------------------------------------------------------------------

def to_date_strict(c: str | Column) -> Column:
    """Date coercion; with ANSI on a malformed value fails the job."""
    return F.to_date(col(c))


def to_date_lenient(c: str | Column) -> Column:
    """Date coercion that turns malformed values into NULL."""
    return F.try_to_date(col(c))


def day_diff(later: str | Column, earlier: str | Column) -> Column:
    """Whole days between two DATE values (lead time / cycle time)."""
    return F.datediff(col(later), col(earlier)).cast("bigint")


def floor_day_diff(later: str | Column, earlier: str | Column, lenient: bool = False) -> Column:
    """Whole elapsed days between two points in time, floored (a 23:00 -> 01:00
    span is 0 days, the reverse is -1).  Wall clocks are compared, so the
    session time zone doesn't matter."""
    def wall(c: str | Column) -> Column:
        return col(c).try_cast("timestamp_ntz") if lenient else col(c).cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", wall(earlier), wall(later))
    return F.floor(micros / F.lit(86_400_000_000)).cast("bigint")


def ntz_as_utc(c: str | Column) -> Column:
    """TIMESTAMP_NTZ wall clock -> TIMESTAMP instant at that wall clock in UTC.

    A plain cast reads the wall clock in the SESSION time zone, which would
    move events across day windows on a non-UTC session; this form does not
    depend on the session zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, col(c)))


def utc_date(c: str | Column) -> Column:
    """Calendar date (UTC) of a TIMESTAMP instant, independent of the session zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(col(c)) / F.lit(86_400_000_000)).cast("int"))


def month_start(c: str | Column) -> Column:
    """First day of the month as a DATE (``trunc`` keeps the DATE type)."""
    return F.trunc(col(c), "MM")


def month_label(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM")


# --- numbers ----------------------------------------------------------------

def nan_to_null(c: str | Column) -> Column:
    """NaN is 'missing' in the metrics; Spark aggregates would propagate it."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, and 0 when the denominator is 0 or NULL."""
    return F.coalesce(F.try_divide(col(num).cast("double"), col(den).cast("double")), F.lit(0.0))


def ratio_round(c: str | Column) -> Column:
    """Round a non-money double so the result does not depend on the
    summation order chosen by the engine."""
    return F.round(col(c), settings.RATIO_DECIMALS)


def money(c: str | Column) -> Column:
    """Exact decimal form of a money value for summation (no rounding to cents)."""
    return col(c).cast(T.DecimalType(28, settings.MONEY_SCALE))


def money_round(c: Column) -> Column:
    return F.round(c.cast("double"), settings.MONEY_DECIMALS)


def money_sum(c: str | Column) -> Column:
    """Exact sum of a money column as DOUBLE; only the sum is rounded."""
    return money_round(F.sum(money(c)))


def money_avg(c: str | Column) -> Column:
    """Mean of a money column from an exact sum."""
    return (F.sum(money(c)).cast("double") / F.count(col(c))).cast("double")


def weighted(total: Column, times: Column) -> Column:
    """An exact money sum times a row count, still exact."""
    return total.cast(T.DecimalType(27, settings.WEIGHTED_SCALE)) * times.cast(T.DecimalType(10, 0))


def bool_to_int(c: str | Column) -> Column:
    return F.when(col(c), F.lit(1)).otherwise(F.lit(0))


def share(cond: Column) -> Column:
    """Mean of a boolean condition as a rounded share (NULL rows excluded)."""
    return ratio_round(F.avg(cond.cast("double")))


# --- bands ------------------------------------------------------------------

def lead_time_band(c: str | Column) -> Column:
    th = settings.LEAD_TIME_THRESHOLDS
    c = col(c)
    return (F.when(c <= th["excellent"], F.lit("excellent"))
            .when(c <= th["good"], F.lit("good"))
            .when(c.isNotNull(), F.lit("poor")))


def valid_lead_time(c: str | Column) -> Column:
    return col(c).between(settings.VALID_LEAD_TIME_MIN, settings.VALID_LEAD_TIME_MAX)


# --- keys -------------------------------------------------------------------

def location_id(country: str | Column, state: str | Column) -> Column:
    """Country || '_' || State; NULL when either part is NULL."""
    return F.concat(col(country), F.lit("_"), col(state))


def inventory_id(product_id: str | Column, date: str | Column) -> Column:
    return F.concat(col(product_id).cast("string"), F.lit("_"), F.date_format(col(date), "yyyyMMdd"))


def stable_id(prefix: str, *parts: str | Column) -> Column:
    """Deterministic id from a natural key (no row index on a distributed frame)."""
    text = F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.md5(text))


def unit_hash(*parts: str | Column, seed: int = 0) -> Column:
    """Uniform number in [0, 1) from a key: first 32 bits of md5(key|seed).

    Partition-independent, so a sample drawn with it is the same on any
    cluster layout and can be recomputed by any SQL engine with md5.
    """
    text = F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rate_lookup(category: str | Column, rates: Mapping[str, float] | None = None,
                default: float | None = None) -> Column:
    """Per-row lookup in a small literal map with a default."""
    rates = settings.RETURN_RATES if rates is None else rates
    default = settings.DEFAULT_RETURN_RATE if default is None else default
    pairs = []
    for k, v in rates.items():
        pairs += [F.lit(k), F.lit(float(v))]
    mapping = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
    return F.coalesce(F.try_element_at(mapping, col(category)), F.lit(float(default)))


# --- JSON cleaning ----------------------------------------------------------

def json_value(c: Column, data_type: T.DataType) -> Column:
    """Value as it appears in a cleaned JSON record: dates as yyyy-MM-dd,
    +-inf and NaN as missing; numbers and booleans keep their type."""
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.when(~(F.isnan(c) | (F.abs(c) == F.lit(float("inf")))), c)
    return c
