"""Salted join for hot keys: exact result, hot key spread over buckets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from chainlens.functions.frames import hot_keys, salted_join
from chainlens.sources import fixtures as FX


def _frames(spark):
    left = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 997).alias("k"), F.col("id").alias("v"))
    right = spark.range(0, 997, 2).select(F.col("id").alias("rk"), (F.col("id") * 10).alias("w"))
    return left, right


def test_hot_keys_detects_the_third(spark):
    left, _ = _frames(spark)
    assert hot_keys(left, ["k"], 0.2) == [(7,)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_equals_plain(spark, how):
    left, right = _frames(spark)
    plain = left.join(right, left.k == right.rk, how)
    salted = salted_join(left, right, [("k", "rk")], how, hot=[(7,)], buckets=8)
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect()))


def test_hot_key_rows_spread_over_buckets(spark):
    left, right = _frames(spark)
    hot_rows = left.where("k = 7").withColumn("salt", F.pmod(F.xxhash64("k", "v"), F.lit(8)))
    per_bucket = [r["count"] for r in hot_rows.groupBy("salt").count().collect()]
    assert len(per_bucket) == 8 and max(per_bucket) < 2 * 10_000 / 8


def test_adapter_with_salting_equals_plain(spark):
    plain = FX.order_lines(FX.raw(spark, SF_SMALL))
    salted = FX.order_lines(FX.raw(spark, SF_SMALL), skew_share=0.0005)
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect()))
