"""Distinct counts rolled up from stored states equal counts over the lines."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from chainlens.operators import distinct as D


def _lines(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(40), rng.choice(["a", "b", None]), rng.choice([None, f"O{rng.randrange(4000)}", "hot"])) for _ in range(30_000)]
    return spark.createDataFrame(rows + [(3, "none", None)], "day int, category string, order_id string").withColumn(
        "week", F.floor(F.col("day") / 7))


def _exact(df, keys):
    return {tuple(r[k] for k in keys): r["n"] for r in df.groupBy(*keys).agg(F.count_distinct("order_id").alias("n")).collect()}


def test_bitmaps_are_exact_at_every_grain(spark, tmp_root):
    df = _lines(spark)
    path = tmp_root + "/state"
    D.bitmap_state(df, ["day", "week", "category"], "order_id", D.number_values(df, "order_id")).write.parquet(path)
    state = spark.read.parquet(path)
    for keys in (["day", "category"], ["week", "category"], ["week"], ["category"]):
        got = {tuple(r[k] for k in keys): r["n"] for r in D.bitmap_rollup(state, keys, "n").collect()}
        assert got == _exact(df, keys)
    half = state.where("day < 20").unionByName(state.where("day >= 20"))  # states of two runs
    assert D.bitmap_rollup(half, ["category"], "n").count() == 4


def test_sketches_stay_within_their_error(spark):
    df = _lines(spark)
    state = D.sketch_state(df, ["day", "week", "category"], "order_id")
    for keys in (["week", "category"], ["category"]):
        want = _exact(df, keys)
        for r in D.sketch_rollup(state, keys, "n").collect():
            n = want[tuple(r[k] for k in keys)]
            assert abs(r["n"] - n) <= 5 * D.relative_error() * n + 1


def test_empty(spark):
    df = _lines(spark).where("false")
    assert D.bitmap_rollup(D.bitmap_state(df, ["day"], "order_id", D.number_values(df, "order_id")), ["day"], "n").count() == 0
    assert D.sketch_rollup(D.sketch_state(df, ["day"], "order_id"), ["day"], "n").count() == 0
