"""Helpers shared by the text operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.session import scratch_path

# The white space that separates words, and the letters whose case is ignored.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# Stands for a missing document id: below every real one.
NO_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Array of the maximal runs of non-white-space characters (empty array for null or blank)."""
    bare = F.btrim(F.coalesce(c, F.lit("")), F.lit(WS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WS_CLASS + "+"))


def doc_key(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(NO_ID))


def written(df: DataFrame, name: str, compression: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to a fresh folder on the shared scratch root and read it
    back: cuts the lineage, survives lost executors, is evaluated once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with as many leading underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def sliced(batches, rows: int = 256):
    """Arrow batches in slices of a few rows, so that a task holds few texts as Python objects at once."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


def range_number(c: Column, cuts: list[int]) -> Column:
    """Number of sorted ``cuts`` below ``c``, found in groups of about the square root of their count."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i:i + step] for i in range(0, len(cuts), step)]

    def below(edges: Column) -> Column:
        return F.size(F.filter(edges, lambda x: x < c))

    whole = below(F.array(*[F.lit(g[-1]) for g in groups]))
    last = F.get(F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups]), whole)
    return (whole * step + F.when(last.isNull(), 0).otherwise(below(last))).cast("int")


def quantile_cuts(df: DataFrame, column: str, parts: int) -> list[int]:
    """Up to ``parts - 1`` distinct values that deal the rows into even ranges."""
    if parts < 2:
        return []
    found = df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 100_000)).first()[0]
    return sorted(set(found or []))


def join_by_size(left: DataFrame, right: DataFrame, on: list[str], size: str, total: int,
                 hot_share: int = 1000) -> DataFrame:
    """Inner join with a side of one row a key whose count of left rows is ``size``.

    Keys with over ``total / hot_share`` rows, of which there are at most
    ``hot_share``, are broadcast, so their left rows stay where they are; the
    others are shuffled."""
    limit = max(1, total // hot_share)
    hot = F.broadcast(right.where(F.col(size) > limit))
    return left.join(hot, on).unionByName(
        left.join(hot.select(*on), on, "left_anti").join(right.where(F.col(size) <= limit), on))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
