"""Distributed exact percentiles equal Spark's exact percentile."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from chainlens.operators import dashboard as D
from chainlens.operators.quantiles import describe_distributed, exact_percentiles, grouped_percentiles, series_percentiles
from chainlens.sources import fixtures as FX

QS = [0.0, 0.25, 0.5, 0.95, 1.0]


def _reference(df, col):
    return df.agg(*[F.percentile(col, q).alias(f"q{i}") for i, q in enumerate(QS)]).first()


@pytest.mark.parametrize("buckets,small", [(4096, 10_000), (4, 3), (16, 50)])
@pytest.mark.parametrize("reuse", ["true", "false"])
def test_matches_spark_percentile_with_hot_value(spark, buckets, small, reuse):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    rnd = random.Random(5)
    vals = [rnd.random() * 100 for _ in range(600)] + [42.5] * 300 + [float("nan"), None] + [1.0, 1.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    try:
        got = exact_percentiles(df, "v", QS, buckets=buckets, small=small).first()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    ref = _reference(df.where(~F.isnan("v")), "v")
    for i, q in enumerate(QS):
        assert got[i] == pytest.approx(ref[i], rel=1e-12, abs=1e-12), q


def test_single_value_and_empty(spark):
    one = spark.createDataFrame([(3.0,)], "v double")
    assert list(exact_percentiles(one, "v", [0.5, 0.95]).first()) == [3.0, 3.0]
    empty = spark.createDataFrame([], "v double")
    assert list(exact_percentiles(empty, "v", [0.5]).first()) == [None]


def test_extreme_values(spark):
    vals = [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1.0, 1e300, -1e-300] + [float(i) for i in range(50)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = exact_percentiles(df, "v", [0.0, 0.5, 1.0], buckets=8, small=2).first()
    vals.sort()
    assert list(got) == [vals[0], (vals[28] + vals[29]) / 2, vals[-1]]


def test_describe_equals_percentile(spark):
    inv = FX.tables(spark, SF_SMALL).inventory
    assert D.turnover_describe(inv).columns == D.turnover_describe(inv, exact=False).columns
    b = describe_distributed(inv, "annualized_turnover").first().asDict()
    ref = inv.agg(*[F.percentile("annualized_turnover", q) for q in (0.25, 0.5, 0.75)]).first()
    for k, v in zip(("p25", "p50", "p75"), ref):
        assert b[k] == pytest.approx(v, abs=2e-6), k


def test_no_value_map_in_one_task(spark):
    from chainlens.operators import metrics as M
    inv = FX.tables(spark, SF_SMALL).inventory
    for df in (M.inventory_turnover_metrics(inv), M.days_of_inventory_metrics(inv), M.fill_rate_metrics(inv)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and "median(" not in plan.replace("median_", "")


def test_columns_and_groups_share_the_passes(spark):
    rnd = random.Random(9)
    inf = float("inf")
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([rnd.gauss(0, 1e6), 7.0, rnd.random()]),
             rnd.choice([inf, -inf, 1.5, rnd.random(), None, float("nan")])) for _ in range(900)] + [("one", 2.0, inf), ("none", None, None)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    for buckets, small in ((4096, 10_000), (8, 3), (40, 20)):
        got = series_percentiles(df, {"v": "v", "w": F.col("w")}, QS, "g", buckets, small)
        assert {g for g, _ in got} == {"a", "b", None, "one"}
        for g in ("a", "b", None, "one"):
            for col in ("v", "w"):
                ref = _reference(df.where(F.col("g").eqNullSafe(F.lit(g)) & ~F.isnan(col)), col)
                for have, want in zip(got[(g, col)], ref):
                    assert have == pytest.approx(want, rel=1e-12, abs=1e-12), (g, col, buckets)
    table = grouped_percentiles(df, {"v": "v"}, [0.5], "g")
    assert table.columns == ["g", "name", "p50"] and table.count() == 4


def test_infinite_values(spark):
    inf = float("inf")
    for vals in ([inf, 1.0, 2.0], [-inf, inf], [inf], [-inf, -inf, 3.0, 4.0, inf]):
        df = spark.createDataFrame([(v,) for v in vals], "v double")
        got, ref = exact_percentiles(df, "v", QS).first(), _reference(df, "v")
        assert [str(x) for x in got] == [str(x) for x in ref], vals
