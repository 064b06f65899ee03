"""The maintained vendor mart equals the full one after any inserts and deletes."""

from __future__ import annotations

import os
import random

from chainlens.operators import marts as MT
from chainlens.plans import incremental as I
from chainlens.sources.snapshots import Snapshots

LINES = "order_id string, product_id string, lead_time_days bigint, sales double, profit double, order_value double"
RETURNS = "order_id string, return_id string"


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_any_inserts_and_deletes(spark, tmp_root):
    rng = random.Random(21)
    products = spark.createDataFrame([(f"P{i}", rng.choice(["A", "B", None])) for i in range(6)], "product_id string, category string")
    path = os.path.join(tmp_root, "mart")
    lines, returns = [], []
    for batch in range(7):
        new_lines = [(rng.choice(["O1", "O2", "O3", f"O{rng.randrange(20)}", None]), rng.choice(["P0", "P1", "P5", "P9"]),
                      rng.choice([None, 1, 5]), rng.choice([None, 10.25, 3.5]), rng.choice([1.125, None]), rng.choice([None, 20.5]))
                     for _ in range(rng.randrange(12))]
        new_returns = [(rng.choice(["O1", "O2", f"O{rng.randrange(20)}", None]), rng.choice([None, "R1", "R2", f"R{rng.randrange(30)}"]))
                       for _ in range(rng.randrange(6))]
        dead_lines = rng.sample(lines, min(len(lines), rng.randrange(6))) if batch < 6 else list(lines)
        dead_returns = rng.sample(returns, min(len(returns), rng.randrange(4)))
        for x in dead_lines:
            lines.remove(x)
        for x in dead_returns:
            returns.remove(x)
        if batch == 6:
            new_lines = new_lines[:1]
        lines, returns = lines + new_lines, returns + new_returns
        dl = spark.createDataFrame([(*r, 1) for r in new_lines] + [(*r, -1) for r in dead_lines], LINES + ", _sign int").coalesce(1)
        dr = spark.createDataFrame([(*r, 1) for r in new_returns] + [(*r, -1) for r in dead_returns], RETURNS + ", _sign int").coalesce(1)
        for _ in range(1 + (batch == 2)):  # a batch that is done again
            I.apply_batch(spark, path, batch, dl, dr, products, fanout=3, min_age_s=0)
        full = MT.mart_vendor_performance(spark.createDataFrame(lines, LINES), products, spark.createDataFrame(returns, RETURNS))
        got = I.read_mart(spark, path)
        assert got.columns == full.columns or set(got.columns) == set(full.columns)
        assert rows(got) == rows(full), batch
    assert len(Snapshots(spark, path).read()[1]["runs"]) <= 4


def test_a_batch_deals_lines_and_returns_out_once(spark):
    """One exchange by order a side, and the one of the category sums; the states before and after come from one pass."""
    from pyspark.sql import functions as F
    lines = spark.range(100).selectExpr("concat('=', id % 30) as _k", "'c' || id % 3 as category", "id % 2 = 0 as _old",
                                        *[f"cast(1 as {I.EXACT if c in I._MONEY else 'long'}) as {c}" for c in I.LINE_SUMS])
    returns = spark.range(50).selectExpr("concat('=', id % 40) as _k", "'r' || id as return_id", "1L as rows", "id % 2 = 0 as _old")
    plan = I._mart_sums(lines.repartition("_k"), returns.repartition("_k"))
    got = {c: sum(r[c] for r in plan.collect()) for c in I.MART_SUMS}
    old = F.col("_old")
    before = I._mart_sums(lines.where(old), returns.where(old)).groupBy().sum("lines", "ids")
    assert got["lines"] == 50 and before.first()[0] == 0  # all rows old: nothing changes
    text = plan._jdf.queryExecution().executedPlan().toString()
    text = text.split("+- == Initial Plan ==")[-1]
    assert text.count("Exchange hashpartitioning") == 3
