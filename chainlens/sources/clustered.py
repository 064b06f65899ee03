"""Tables clustered by several columns at once, and read through zone maps.

Each cluster column is cut at quantiles of a bounded sample (``SAMPLE`` rows,
those with the smallest hashes; it steers the layout, never the result).  The
bits of the cut numbers are interleaved (Z-order), and the rows are split into
files by ranges of that number, after the ``leading`` columns if any are given.
A file thus covers a small box in all cluster columns, where a plain sort
narrows the first one only.

A zone table holds, for each file, its rows and each column's smallest and
largest value.  A filter is answered from the zones first: files whose box
misses it are not opened.  The filter is then applied to the rows of the others.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chainlens.sources import snapshots as SNAP

SAMPLE = 10_000
BITS = 6                    # 64 parts a column
ROWS_PER_FILE = 1_000_000


def cuts(df: DataFrame, cols: list[str], bits: int = BITS, sample: int = SAMPLE) -> dict[str, list]:
    """At most ``2**bits - 1`` rising values a column that split a sample of its rows evenly."""
    picked = df.select(*cols).orderBy(F.xxhash64(*cols), *cols).limit(sample)
    rows = picked.collect()
    out = {}
    for k, c in enumerate(cols):
        values = sorted(r[k] for r in rows if r[k] is not None and r[k] == r[k])
        parts = 1 << bits
        out[c] = sorted({values[len(values) * i // parts] for i in range(1, parts)}) if values else []
    return out


def z_number(cuts_of: dict[str, list], bits: int = BITS) -> Column:
    """The columns' part numbers with their bits interleaved, the first column's highest."""
    z = F.lit(0).cast("long")
    n = len(cuts_of)
    if n * bits > 62:
        raise ValueError(f"{n} columns of {bits} bits don't fit a long")

    def spread(part: int, k: int) -> Column:
        return F.lit(sum((part >> b & 1) << (b * n + n - 1 - k) for b in range(bits))).cast("long")

    def search(c: str, values: list, low: int, high: int, k: int) -> Column:
        """The part's spread bits, found by halving: ``low`` to ``high`` cuts may be at or below the value."""
        if low == high:
            return spread(low, k)
        mid = (low + high) // 2
        return F.when(F.col(c) < F.lit(values[mid]), search(c, values, low, mid, k)).otherwise(
            search(c, values, mid + 1, high, k))

    for k, (c, values) in enumerate(cuts_of.items()):
        if values:
            z = z.bitwiseOR(F.when(F.col(c).isNull(), spread(0, k)).otherwise(search(c, values, 0, len(values), k)))
    return z


def build(df: DataFrame, path: str, cols: list[str], leading: list[str] = (), zone_cols: list[str] = (),
          rows_per_file: int = ROWS_PER_FILE, bits: int = BITS) -> int:
    """Create or replace the table at ``path``; returns its version.  Zones are kept of the leading, the
    cluster and the ``zone_cols`` columns.  ``df`` is read four times (count, sample, ranges, write)."""
    log = SNAP.Snapshots(df.sparkSession, path)
    before = max(log.versions(), default=0)
    data, zones = log.folder("data"), log.folder("zones")
    files = df.count() // rows_per_file + 1
    z = "__z"
    order = [*leading, z, *cols]
    (df.withColumn(z, z_number(cuts(df, cols, bits), bits)).repartitionByRange(files, *order)
     .sortWithinPartitions(*order).drop(z).write.parquet(data))
    kept = list(dict.fromkeys([*leading, *cols, *zone_cols]))
    bounds = [e for c in kept for e in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))]
    (df.sparkSession.read.schema(df.schema).parquet(data).groupBy(F.col("_metadata.file_name").alias("file"))
     .agg(F.count(F.lit(1)).alias("rows"), *bounds).coalesce(1).write.parquet(zones))
    version = log.publish({"data": data.rsplit("/", 1)[1], "zones": zones.rsplit("/", 1)[1],
                           "schema": df.schema.json(), "zone_cols": kept}, before)
    log.expire()
    return version


class Clustered:
    """One version of a clustered table."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark = spark
        self.version, content = SNAP.Snapshots(spark, path).read(version)
        if content is None:
            raise FileNotFoundError(f"no version of {path}")
        self.data = f"{path.rstrip('/')}/{content['data']}"
        self.schema = StructType.fromJson(json.loads(content["schema"]))
        self.zone_cols = content["zone_cols"]
        self.zones = spark.read.parquet(f"{path.rstrip('/')}/{content['zones']}")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.data)

    def where(self, **bounds: tuple) -> DataFrame:
        """Rows whose columns lie within ``column=(low, high)``, ends included, None = open.  A NULL lies in
        no bound.  Only files whose zones meet every bound are opened; the bound of a column without zones
        applies to the rows alone."""
        meets, inside = F.lit(True), F.lit(True)
        for c, (low, high) in bounds.items():
            inside = inside & F.col(c).isNotNull()
            if c in self.zone_cols:
                meets = meets & F.col(f"min_{c}").isNotNull()
            if low is not None:
                inside = inside & (F.col(c) >= F.lit(low))
                if c in self.zone_cols:
                    meets = meets & (F.col(f"max_{c}") >= F.lit(low))
            if high is not None:
                inside = inside & (F.col(c) <= F.lit(high))
                if c in self.zone_cols:
                    meets = meets & (F.col(f"min_{c}") <= F.lit(high))
        files = [r[0] for r in self.zones.where(meets).select("file").collect()]
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.data}/{f}" for f in sorted(files)]).where(inside)
