"""J-3 on streams: order lines LEFT JOIN the returns of their order.

Both sides are streams.  A return belongs to the lines of its order if its date
is 0 to ``window_days`` days after theirs.  A matched row is written as soon as
both sides are there; a line without a return is written once its window is
closed, that is when no return that could match it can come any more.

State: a line is kept until the common watermark has passed its date by
``window_days`` and one day, a return until it has passed the return's date, so
the state holds the lines of some ``window_days + delay_days`` days, however
long the stream runs.  ``delay_days`` is how far a row's date may lie behind the
newest date of its own side that came in an earlier micro-batch; what is later
than that is left out.

A backlog (``land``) is first written in the order of its days and then taken in
micro-batches of several weeks.  In one micro-batch all its rows would be state
at once, since the watermarks move between micro-batches only.

Defined results: a line or return without an id or date has no window and is
left out; equal rows each count; an order's lines are paired with each of its
returns, like the batch join.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chainlens.functions import columns as C
from chainlens.functions.frames import one_row_join
from chainlens.session import scratch_path
from chainlens.streaming.kpis import stream_session

WINDOW_DAYS = 30
DELAY_DAYS = 2
BATCH_ROWS = 2_000_000  # lines of a backlog that a micro-batch takes, or more where the state's days hold more
BATCH_FILES = 8         # files of a side that a micro-batch takes
CODEC = "zstd"          # of landed rows, state and result
KEPT_BATCHES = 5        # micro-batches whose state the checkpoint keeps at least, to go on from


def _at(day: str):
    """Event time of a date: its midnight in UTC, whatever the session time zone."""
    return C.ntz_as_utc(F.col(day).cast("timestamp_ntz"))


def orders_with_returns(orders: DataFrame, returns: DataFrame, window_days: int = WINDOW_DAYS,
                        delay_days: int = DELAY_DAYS) -> DataFrame:
    """All columns of ``orders`` with return_id and return_date, NULL where no
    return came in the window.  On tables (not streams) the plain LEFT JOIN."""
    o = orders.where("order_id IS NOT NULL AND order_date IS NOT NULL").withColumn("_order_at", _at("order_date"))
    r = returns.where("order_id IS NOT NULL AND return_date IS NOT NULL").select(
        F.col("order_id").alias("_return_order"), "return_id", "return_date", _at("return_date").alias("_return_at"))
    if orders.isStreaming:
        o = o.withWatermark("_order_at", f"{delay_days} days")
        r = r.withWatermark("_return_at", f"{delay_days} days")
    # The range on the event times lets Spark drop state. It has a day to spare, since a day of the
    # session's time zone may have 23 or 25 hours; the whole-day difference decides.
    on = ((F.col("order_id") == F.col("_return_order"))
          & (F.col("_return_at") >= F.col("_order_at"))
          & (F.col("_return_at") <= F.col("_order_at") + F.expr(f"INTERVAL {window_days + 1} DAYS"))
          & (F.datediff("return_date", "order_date") <= window_days))
    return o.join(r, on, "left").drop("_order_at", "_return_order", "_return_at")


def closed_lines(rows: DataFrame, orders: DataFrame, returns: DataFrame, window_days: int = WINDOW_DAYS,
                 delay_days: int = DELAY_DAYS) -> DataFrame:
    """The ``rows`` whose window is closed by the dates in ``orders`` and
    ``returns``: for these the stream's output is final and whole."""
    last = one_row_join(orders.agg(F.max("order_date").alias("_o")), returns.agg(F.max("return_date").alias("_r")))
    # least() skips NULL, but with an empty side no window is closed.
    bound = last.select(F.when(F.col("_o").isNotNull() & F.col("_r").isNotNull(), F.date_sub(
        F.least("_o", "_r"), delay_days + window_days + 1)).alias("_closed"))
    return one_row_join(rows, bound).where(F.col("order_date") < F.col("_closed")).drop("_closed")


def backlog_batches(rows: int, days: int, window_days: int = WINDOW_DAYS, delay_days: int = DELAY_DAYS) -> int:
    """Micro-batches for a backlog.  None is shorter than the days that the state keeps, so the state is
    about two of them at most and the work on it, batch by batch, grows no faster than the rows."""
    return max(1, min(-(-rows // BATCH_ROWS), days // (window_days + delay_days + 1)))


def land(rows: DataFrame, day: str, path: str, files: int) -> None:
    """Write a backlog to ``files`` files in the order of ``day``, for a file stream to take in that order.

    A file stream goes by modification times, so the files get times in the order of their names.  Where the
    file system keeps no times that are set, the files are written one after the other instead.  A side never
    goes back in its days by that, so no row of a backlog is late, however far one side is ahead."""
    spark = rows.sparkSession
    rows.repartitionByRange(files, day, "order_id").write.parquet(path, compression=CODEC)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def listed(at) -> list:
        return sorted((f for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")),
                      key=lambda f: f.getPath().getName())

    found = listed(folder)
    first = max((f.getModificationTime() for f in found), default=0) // 1000 - len(found)
    for k, f in enumerate(found):
        fs.setTimes(f.getPath(), 1000 * (first + k), -1)
    times = [f.getModificationTime() for f in listed(folder)]
    if any(a >= b for a, b in zip(times, times[1:])):
        whole = folder.suffix("-unordered")
        fs.rename(folder, whole)
        for f in listed(whole):
            spark.read.schema(rows.schema).parquet(f.getPath().toString()).coalesce(1).write.mode("append").parquet(
                path, compression=CODEC)
            time.sleep(1)  # the next file's time is another one


def backlog_stream(spark: SparkSession, schema, path: str, files: int = BATCH_FILES) -> DataFrame:
    """Stream of a backlog that was landed at ``path``, ``files`` files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def write_stream(joined: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the joined rows to Parquet files, each exactly once."""
    return (joined.writeStream.format("parquet").outputMode("append").option("path", out).option("compression", CODEC)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def batch_result(spark: SparkSession, sf_dir: str, state_partitions: int | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Both streams over the test tables, run to completion and read back:
    lines whose window is closed, with their returns."""
    from chainlens.sources import fixtures as FX
    t, files = FX.tables(spark, sf_dir), max_files_per_trigger or BATCH_FILES
    days = t.raw.table("orders").agg(F.datediff(F.max("o_orderdate"), F.min("o_orderdate"))).first()[0]
    batches = backlog_batches(t.raw.table("lineitem").count(), days or 0)
    base = scratch_path(spark, "stream_orders_with_returns")
    sides = {"orders": (FX.order_lines(t.raw, columns=["order_id", "line_number", "product_id", "supplier_id", "order_date",
                                                       "ship_date", "sales"]), "order_date"),
             "returns": (FX.returns(t.raw, columns=["order_id", "return_id", "return_date"]), "return_date")}
    s = stream_session(spark, state_partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    s.conf.set("spark.sql.streaming.stateStore.compression.codec", CODEC)
    s.conf.set("spark.sql.streaming.minBatchesToRetain", KEPT_BATCHES)
    streams, tables = {}, {}
    for name, (rows, day) in sides.items():
        path = os.path.join(base, name)
        land(rows, day, path, batches * files)
        streams[name] = backlog_stream(s, rows.schema, path, files)
        tables[name] = spark.read.schema(rows.schema).parquet(path)
    out = os.path.join(base, "out")
    joined = orders_with_returns(streams["orders"], streams["returns"])
    write_stream(joined, out, os.path.join(base, "checkpoint")).awaitTermination()
    return closed_lines(spark.read.schema(joined.schema).parquet(out), tables["orders"], tables["returns"])
