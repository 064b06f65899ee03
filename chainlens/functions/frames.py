"""Small DataFrame-level helpers used by several operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nonempty(df: DataFrame, count_col: str) -> DataFrame:
    """Keep a one-row global aggregate only when it saw rows (the
    reference returns an empty result for empty input)."""
    return df.where(F.col(count_col) > 0)


def one_row_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Append the columns of a single-row aggregate to every row of ``left``.

    ``right`` is evaluated once as a scalar subquery and projected into each
    row: no join and no pair generation.  Spark fails the query if ``right``
    ever yields more than one row; with no row its columns are NULL.
    """
    packed = right.selectExpr("struct(*) AS __row").scalar()
    return left.select("*", packed.alias("__row")).selectExpr(
        *[f"`{c}`" for c in left.columns], *[f"__row.`{c}` AS `{c}`" for c in right.columns])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def count_if(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")


def fact_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join of two inputs that BOTH grow with the data (fact to fact).

    Such a join must never be planned as a broadcast: the build side would be
    collected on the driver and copied to every executor.  The MERGE hint
    keeps it a shuffled sort-merge join (which spills, and whose skewed
    partitions AQE splits) whatever the size estimate says.  Joins to
    dimension-sized inputs are left to Catalyst's size check instead.
    """
    return left.join(right.hint("merge"), on, how)


def hot_keys(df: DataFrame, cols: list[str], min_share: float = 0.01) -> list[tuple]:
    """Keys holding at least ``min_share`` of the rows.

    One grouped count (partial aggregation) compared with the row total (a
    scalar subquery); only the hot keys reach the driver, and there can be
    at most ``1 / min_share`` of them.
    """
    total = df.select(F.count(F.lit(1)).alias("n")).scalar()
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    rows = counts.where(F.col("__n") >= total * F.lit(min_share)).select(*cols).collect()
    return [tuple(r) for r in rows]


def salted_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner",
                hot: list[tuple] | None = None, buckets: int = 32) -> DataFrame:
    """Equi-join that spreads hot keys over ``buckets`` tasks.

    Rows of ``left`` whose key is hot get a salt in [0, buckets) from a hash
    of the row (deterministic, so a recomputed task gets the same salt);
    rows of ``right`` with a hot key are replicated once per salt; all other
    rows get salt 0.  The join runs on (key, salt), so every left row still
    meets each matching right row exactly once: the result equals the plain
    join.  Only joins that keep ``left`` rows (inner, left, semi, anti) are
    supported; ``right`` must be the side whose hot-key rows are few.
    """
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"salted_join does not support how={how!r}")
    lcols, rcols = [a for a, _ in on], [b for _, b in on]
    if not hot:
        return fact_join(left, right, [left[a] == right[b] for a, b in on], how)
    hot_l = F.struct(*lcols).isin(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(k, lcols)]) for k in hot])
    hot_r = F.struct(*[F.col(c).alias(a) for c, a in zip(rcols, lcols)]).isin(
        *[F.struct(*[F.lit(v).alias(c) for v, c in zip(k, lcols)]) for k in hot])
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])
    l2 = left.withColumn("__salt_l", F.when(hot_l, F.pmod(row_hash, F.lit(buckets))).otherwise(F.lit(0)))
    r2 = right.withColumn("__salt_r", F.explode(
        F.when(hot_r, F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.lit(0)))))
    cond = [l2[a] == r2[b] for a, b in on] + [l2["__salt_l"] == r2["__salt_r"]]
    out = fact_join(l2, r2, cond, how)
    return out.drop("__salt_l", "__salt_r") if how not in ("left_semi", "left_anti") else out.drop("__salt_l")


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size (file sizes, less what filters and columns leave out)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dim_join(facts: DataFrame, dim: DataFrame, on: list[tuple[str, str]], skew_share: float | None = None) -> DataFrame:
    """LEFT JOIN of facts to a dimension.

    Below the session's broadcast size the dimension is left to Spark, which
    broadcasts it; hot keys don't matter then.  Above it, keys with at least
    ``skew_share`` of the facts are salted in a sort-merge join."""
    cond = [facts[a] == dim[b] for a, b in on]
    limit = facts.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    limit = int(facts.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit)) \
        if not limit.lstrip("-").isdigit() else int(limit)
    if not skew_share or size_in_bytes(dim) <= limit:
        return facts.join(dim, cond, "left")
    return salted_join(facts, dim, on, "left", hot=hot_keys(facts, [a for a, _ in on], skew_share))
