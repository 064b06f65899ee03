"""Exact percentiles whose work is spread over the cluster.

Spark's exact ``percentile`` merges one value -> count map per group into a
single task.  That is fine while the value domain is small (whole-day lead
times, inventory ratios of small integers) but not for arbitrary doubles
over billions of rows.  ``exact_percentiles`` computes the same linear-
interpolated result with bounded per-task state:

1. count rows per distinct value (partial aggregation; a value holding a
   third of all rows collapses to one row);
2. cut the values into equal-width buckets between the minimum and the
   maximum, so a row's bucket depends on its value alone;
3. per-bucket totals -> running offsets (one row per bucket);
4. the few buckets that hold a wanted rank are cut again, until a bucket
   that matters is small; a running count inside these gives the value.

Several columns and groups share the passes.  Infinite values are counted
apart, so cuts are always between finite ends.

Each cut is one aggregate with a bounded result; no plan relies on two
evaluations of a partitioning giving the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlens.functions import columns as C
from chainlens.functions.frames import one_row_join
from chainlens.session import scratch_path

BUCKETS = 4096      # buckets of one cut
SMALL = 10_000      # distinct values that are brought back for a rank


def exact_percentiles(df: DataFrame, col: str | Column, qs: list[float], buckets: int = BUCKETS, small: int = SMALL,
                      prefix: str = "p") -> DataFrame:
    """One row with a column per quantile (``p25`` for 0.25, ``p50`` for
    0.5, ``p95`` for 0.95 ...), equal to ``percentile(col, q)``; NULL / NaN
    values are ignored, and an empty input gives NULLs."""
    found = series_percentiles(df, {"x": col}, qs, buckets=buckets, small=small)
    schema = ", ".join(f"`{prefix}{_label(q)}` double" for q in qs)
    return df.sparkSession.createDataFrame([tuple(found.get((None, "x"), [None] * len(qs)))], schema)


def grouped_percentiles(df: DataFrame, columns: dict[str, str | Column], qs: list[float], by: str) -> DataFrame:
    """(``by``, column name, quantiles) for every group of ``by`` and column that has a value.

    The groups must be few (categories, regions): one row a group and column comes to the driver."""
    found = series_percentiles(df, columns, qs, by)
    kind = df.select(by).schema[0].dataType.simpleString()
    schema = f"`{by}` {kind}, name string, " + ", ".join(f"p{_label(q)} double" for q in qs)
    return df.sparkSession.createDataFrame([(g, n, *v) for (g, n), v in found.items()], schema)


def exact_medians(df: DataFrame, columns: dict[str, str | Column]) -> dict[str, Column]:
    """The exact median of each column as a literal, from one read of ``df``.

    This runs jobs when it is called: a median of unbounded values is no single aggregate."""
    found = series_percentiles(df, columns, [0.5])
    return {n: F.lit(found.get((None, n), [None])[0]).cast("double") for n in columns}


def series_percentiles(df: DataFrame, columns: dict[str, str | Column], qs: list[float], by: str | None = None,
                       buckets: int = BUCKETS, small: int = SMALL) -> dict[tuple, list[float]]:
    """(group, column name) -> exact quantiles, for all columns and groups in the same passes.

    ``df`` is read once; each pass cuts the ranges that still hold a wanted
    rank, of all columns and groups, in one job.  A pass brings back at most
    about ``buckets`` rows, or ``small`` rows a range that ends the search."""
    spark, names = df.sparkSession, list(columns)
    group = F.col(by) if by else F.lit(None).cast("string")
    values = F.inline(F.array(*[F.struct(F.lit(i).alias("s"), C.nan_to_null(c).cast("double").alias("x"))
                                for i, c in enumerate(columns.values())]))
    # A value that holds a third of all rows is one row from here on.
    rows = df.select(group.alias("g"), values).where(F.col("x").isNotNull()).groupBy("s", "g", "x").agg(
        F.count(F.lit(1)).alias("c"))
    path = scratch_path(spark, "value_counts")
    rows.write.parquet(path)
    counts = spark.read.schema(rows.schema).parquet(path)  # the input is read once, whatever the cuts
    finite = F.abs("x") != float("inf")
    finite_x = F.when(finite, F.col("x"))
    totals = counts.groupBy("s", "g").agg(
        F.min(finite_x).alias("low"), F.max(finite_x).alias("high"), F.sum("c").alias("n"),
        F.count(finite_x).alias("distinct"), F.coalesce(F.sum(F.when(F.col("x") == -float("inf"), F.col("c"))), F.lit(0)).alias("below"),
        F.coalesce(F.sum(F.when(finite, F.col("c"))), F.lit(0)).alias("inside")).collect()
    found: dict[tuple, dict[int, float]] = {}
    ranges = []
    for t in totals:
        at = found[(t["s"], t["g"])] = {}
        for r in sorted({int(f(q * (t["n"] - 1))) for q in qs for f in (math.floor, math.ceil)}):
            if r < t["below"]:
                at[r] = -math.inf
            elif r >= t["below"] + t["inside"]:
                at[r] = math.inf
            else:
                at[r] = None
        ranks = [r for r, v in at.items() if v is None]
        if ranks:
            ranges.append((t["s"], t["g"], t["low"], t["high"], t["distinct"], t["below"], ranks))
    kind = counts.schema["g"].dataType.simpleString()
    while ranges:
        for s, g, low, high, _, _, ranks in ranges:
            if low == high:
                found[(s, g)].update({r: low for r in ranks})
        ranges = [r for r in ranges if r[2] != r[3]]
        ending = [r for r in ranges if r[4] <= small]
        wide = [r for r in ranges if r[4] > small]
        ranges = []
        for i, x, c in _inside(counts, ending, kind, None):
            s, g, _, _, _, before, ranks = ending[i]
            found[(s, g)].update({r: x for r in ranks if before <= r < before + c})
            ending[i] = (*ending[i][:5], before + c, ranks)
        for i, low, high, c, distinct in _inside(counts, wide, kind, max(2, buckets // max(1, len(wide)))):
            s, g, _, _, _, before, ranks = wide[i]
            mine = [r for r in ranks if before <= r < before + c]
            if mine:
                ranges.append((s, g, low, high, distinct, before, mine))
            wide[i] = (*wide[i][:5], before + c, ranks)
    out = {}
    for t in totals:
        at, values = found[(t["s"], t["g"])], []
        for q in qs:
            p = q * (t["n"] - 1)
            low, high = at[math.floor(p)], at[math.ceil(p)]
            part = p - math.floor(p)
            if low == high or math.isfinite(low) and math.isfinite(high):
                values.append(low if low == high else low + (high - low) * part)
            else:
                values.append((1 - part) * low + part * high)
        out[(t["g"], names[t["s"]])] = values
    return out


def _inside(counts: DataFrame, ranges: list[tuple], kind: str, buckets: int | None) -> list[tuple]:
    """For each range, in order: its values with their counts, or (``buckets``) its cuts
    with their least and greatest value, count and number of values."""
    if not ranges:
        return []
    # Each end alone is divided, so that the widest range doesn't overflow.
    rows = [(i, s, g, low, high, (high / buckets - low / buckets) if buckets else 0.0)
            for i, (s, g, low, high, *_) in enumerate(ranges)]
    found = F.broadcast(counts.sparkSession.createDataFrame(rows, f"i int, _s int, _g {kind}, low double, high double, width double"))
    inside = counts.join(found, (F.col("s") == F.col("_s")) & F.col("g").eqNullSafe(F.col("_g"))
                         & F.col("x").between(F.col("low"), F.col("high")))
    if not buckets:
        return sorted((r["i"], r["x"], r["c"]) for r in inside.select("i", "x", "c").collect())
    key = F.floor(F.col("x") / F.col("width") - F.col("low") / F.col("width")).cast("long")
    cut = inside.groupBy("i", key.alias("k")).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.sum("c").alias("c"),
                                                  F.count(F.lit(1)).alias("d")).collect()
    return [(r["i"], r["a"], r["b"], r["c"], r["d"]) for r in sorted(cut, key=lambda r: (r["i"], r["k"]))]


def _label(q: float) -> str:
    v = q * 100
    return str(int(v)) if math.isclose(v, round(v)) else str(v).replace(".", "_")


def exact_median(df: DataFrame, col: str | Column) -> Column:
    """The exact median of a column as a literal."""
    return exact_medians(df, {"x": col})["x"]


def describe_distributed(df: DataFrame, col: str) -> DataFrame:
    """count / mean / std / min / quartiles / max with distributed exact
    quartiles (for unbounded value domains)."""
    t = C.nan_to_null(col)
    base = df.agg(F.count(t).alias("count"), C.ratio_round(F.avg(t)).alias("mean"),
                  C.ratio_round(F.stddev_samp(t)).alias("std"), C.ratio_round(F.min(t)).alias("min"),
                  C.ratio_round(F.max(t)).alias("max"))
    q = exact_percentiles(df, col, [0.25, 0.5, 0.75])
    q = q.select(*[C.ratio_round(c).alias(c) for c in q.columns])
    return one_row_join(base, q).select("count", "mean", "std", "min", "p25", "p50", "p75", "max")
