"""Tables paged by position: pages at any offset without reading the rows before them.

The rows are split into ranges of the sort key, one folder a range, and each
row is written with its position in its range.  A small table holds the rows
of each range and the running sum before it.  The rank of a row is that sum
plus its position, so a page is a condition on positions in the few ranges
that it touches; the folders of the others are not even listed.

The order is ascending with NULLs first.  Rows that are equal in all key columns
share a range, in any order among themselves; a key without repeats gives one order.
Readers pin a version (``snapshots``), so a rebuild does not shift a reader's pages.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from chainlens.sources import snapshots as SNAP

RANGE, POSITION, RANK = "__range", "__position", "rank"
ROWS_PER_RANGE = 1_000_000
BLOCK = 1024  # ranges summed together before blocks are


def build(df: DataFrame, path: str, order_by: list[str], rows_per_range: int = ROWS_PER_RANGE) -> int:
    """Create or replace the paged table at ``path``; returns its version.

    ``df`` is read three times (count, sample of the ranges, write), so pass a
    table, not a long plan.  One range is one task of the write."""
    log = SNAP.Snapshots(df.sparkSession, path)
    before = max(log.versions(), default=0)
    data, sums = log.folder("data"), log.folder("ranges")
    ranges = df.count() // rows_per_range + 1
    (df.repartitionByRange(ranges, *order_by).withColumn(RANGE, F.spark_partition_id())
     .sortWithinPartitions(RANGE, *order_by)
     # the low 33 bits count the rows of a task
     .withColumn(POSITION, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
     .write.partitionBy(RANGE).parquet(data))
    written = df.sparkSession.read.schema(_schema(df.schema)).parquet(data)
    _running(written.groupBy(RANGE).agg(F.count(F.lit(1)).alias("rows"))).coalesce(1).write.parquet(sums)
    version = log.publish({"data": data.rsplit("/", 1)[1], "ranges": sums.rsplit("/", 1)[1],
                           "schema": df.schema.json(), "order_by": order_by}, before)
    log.expire()
    return version


def _schema(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(POSITION, LongType()), StructField(RANGE, IntegerType())])


def _running(counts: DataFrame) -> DataFrame:
    """``first``: rows of the ranges before.  Sums inside blocks of ranges, then over the blocks: a task
    sorts ``BLOCK`` ranges, or one row a block."""
    counts = counts.withColumn("block", F.floor(F.col(RANGE) / BLOCK))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    blocks = (counts.groupBy("block").agg(F.sum("rows").alias("block_rows"))
              .withColumn("block_first", F.coalesce(F.sum("block_rows").over(before.orderBy("block")), F.lit(0))))
    inside = counts.withColumn("inside", F.coalesce(F.sum("rows").over(before.partitionBy("block").orderBy(RANGE)), F.lit(0)))
    return (inside.join(blocks, "block")
            .select(RANGE, "rows", (F.col("block_first") + F.col("inside")).cast("long").alias("first")))


class Pages:
    """One version of a paged table."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark = spark
        self.version, content = SNAP.Snapshots(spark, path).read(version)
        if content is None:
            raise FileNotFoundError(f"no version of {path}")
        self.data = f"{path.rstrip('/')}/{content['data']}"
        self.schema = StructType.fromJson(json.loads(content["schema"]))
        self.order_by = content["order_by"]
        self.ranges = (spark.read.schema(f"{RANGE} int, rows long, first long")
                       .parquet(f"{path.rstrip('/')}/{content['ranges']}"))

    def total(self) -> int:
        return self.ranges.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def page(self, offset: int | None = None, limit: int | None = None, with_rank: bool = False) -> DataFrame:
        """Rows ``offset`` .. ``offset + limit - 1`` of the order; None or 0 = unset, as in ``dashboard.page``.
        Unset limits read everything after the offset.  The rows come unsorted with their ``rank`` (from 0)
        if ``with_rank``, else sorted."""
        low = F.col("first") + F.col("rows") > (offset or 0)
        hit = self.ranges.where(low & (F.col("first") < (offset or 0) + limit) if limit else low)
        if limit:
            # at most limit / rows of a range + 2 ranges: their folders are named, positions reach the scan
            found = [tuple(r) for r in hit.select(RANGE, "first").collect()]
            if not found:
                return self._shaped(self.spark.createDataFrame([], _schema(self.schema)).withColumn(RANK, F.lit(0).cast("long")), with_rank)
            rows = (self.spark.read.schema(_schema(self.schema)).option("basePath", self.data)
                    .parquet(*[f"{self.data}/{RANGE}={n}" for n, _ in found]))
            ends = F.lit(False)
            for n, first in found:
                ends = ends | ((F.col(RANGE) == n) & F.col(POSITION).between((offset or 0) - first, (offset or 0) + limit - 1 - first))
            first_of = F.create_map(*[F.lit(x) for pair in found for x in pair])
            return self._shaped(rows.where(ends).withColumn(RANK, first_of[F.col(RANGE)] + F.col(POSITION)), with_rank)
        rows = self.spark.read.schema(_schema(self.schema)).parquet(self.data)
        rows = rows.join(hit.select(RANGE, "first"), RANGE).withColumn(RANK, F.col("first") + F.col(POSITION))
        return self._shaped(rows.where(F.col(RANK) >= (offset or 0)), with_rank)

    def _shaped(self, rows: DataFrame, with_rank: bool) -> DataFrame:
        names = self.schema.fieldNames()
        return rows.select(*names, RANK) if with_rank else rows.orderBy(RANK).select(*names)
