"""Distinct counts that roll up without the lines.

``COUNT(DISTINCT order)`` a day and category can't be added up to a month: an
order may have lines on several days.  What can be merged is a state a day and
category, stored once and rolled up to any coarser grain:

* ``bitmap_state``  exact.  Values are numbered once (``number_values``, written);
  the state is a row per group and block of 32,768 numbers, a bitmap of 4 KB at
  most whatever the number of lines.  Bitmaps are merged by OR, and a group's
  count is the sum over its blocks.
* ``sketch_state``  approximate, of bounded size: a HyperLogLog sketch of
  2 ** ``lg_k`` registers a group, with a relative standard error of about
  1.04 / sqrt(2 ** lg_k).

NULL values are not counted.  All steps are partial aggregates, so a group that
holds a third of all lines reaches the shuffle as one state a task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.session import scratch_path

LG_K = 12


def relative_error(lg_k: int = LG_K) -> float:
    return 1.04 / math.sqrt(2 ** lg_k)


def number_values(df: DataFrame, col: str) -> DataFrame:
    """(col, number): each distinct value with a number of its own, written so that the numbers stay.
    Numbers follow each other within a task's part, so bitmaps are dense."""
    path = scratch_path(df.sparkSession, "value_numbers")
    (df.select(col).where(F.col(col).isNotNull()).distinct().withColumn("number", F.monotonically_increasing_id())
     .write.parquet(path))
    return df.sparkSession.read.parquet(path)


def bitmap_state(df: DataFrame, keys: list[str], col: str, numbers: DataFrame) -> DataFrame:
    """(keys, block, bits) for the distinct values of ``col`` per ``keys``; a group of NULLs alone has block NULL."""
    pairs = df.select(*keys, col).distinct().join(numbers, col, "left")
    return pairs.groupBy(*keys, F.bitmap_bucket_number("number").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def bitmap_rollup(state: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): exact distinct counts at a grain that the state's keys determine."""
    blocks = state.groupBy(*keys, "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    return blocks.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("block").isNotNull(), F.bitmap_count("bits"))), F.lit(0))
                                     .alias(name))


def sketch_state(df: DataFrame, keys: list[str], col: str, lg_k: int = LG_K) -> DataFrame:
    """(keys, sketch)."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(F.col(col), lg_k).alias("sketch"))


def sketch_rollup(state: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): estimated distinct counts."""
    return state.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))
