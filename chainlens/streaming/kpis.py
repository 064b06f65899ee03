"""Structured Streaming forms of the live KPIs and alerts.

ST-1  daily KPI counts / sums per event type over tumbling windows;
      each micro-batch upserts the days that changed.
ST-2  stateless alert filter (append).
ST-3  incremental refresh of a fact table: each micro-batch rebuilds the
      partitions that it touches, those that its keys move out of included,
      from their stored rows and its own.

Sources are table paths, a file or a folder of files.  Sinks, state and
checkpoints are written below the shared scratch root.
"""

from __future__ import annotations

import json
import os
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from chainlens.functions import columns as C
from chainlens.session import scratch_path
from chainlens.sources.snapshots import MIN_AGE_S, Snapshots

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
KPI_KEY = ["day", "event_type"]
LINE_KEY = ["order_id", "line_number", "product_id", "supplier_id", "ship_date"]


def file_stream(spark: SparkSession, schema, path: str, max_files_per_trigger: int | None) -> DataFrame:
    """Stream of a Parquet table, one file or a folder of them.  A file
    source watches folders, so a file is its folder filtered by its name."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return r.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return r.parquet(path)


def event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of events; ``ts`` becomes a TIMESTAMP instant (watermarks need
    TIMESTAMP, the files hold TIMESTAMP_NTZ), read as UTC wall clock whatever
    the session time zone."""
    return file_stream(spark, EVENTS_SCHEMA, path, max_files_per_trigger).withColumn("ts", C.ntz_as_utc("ts"))


def daily_kpis(events: DataFrame, watermark: str | None = None, window: str = "1 day") -> DataFrame:
    """Per (day window, event type): event count and exact value total.

    On a stream the state has one row a day and event type, so it grows with
    the calendar only, and events count however late they come.  A
    ``watermark`` frees the days that it has passed, at the price that later
    events of these are not counted.  Works on a batch too."""
    if events.isStreaming and watermark:
        events = events.withWatermark("ts", watermark)
    g = events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("events"),
        C.money_sum("value").alias("total_value"))
    return g.select(C.utc_date("w.start").alias("day"), "event_type", "events", "total_value")


# --- a table of merged batches --------------------------------------------------
#
# A version of the table names its runs.  A run holds whole partitions (``data``) and the list of
# partitions that it replaces (``parts``), which may have become empty; of each partition the last
# run that lists it counts.  A batch adds a run; FANOUT runs of one level are merged into one of the
# next, so a table of n batches has at most about FANOUT * log(n) runs.

FANOUT = 8


def _runs(spark: SparkSession, table: str, content: dict, runs: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Rows and partitions of ``runs``, with the run's number as ``_run``."""
    schema, part = T.StructType.fromJson(json.loads(content["schema"])), content["partition"]
    rows = parts = None
    for k, r in enumerate(runs):
        d = spark.read.schema(schema).parquet(f"{table}/{r['folder']}/data").withColumn("_run", F.lit(k))
        p = spark.read.schema(T.StructType([T.StructField("_p", schema[part].dataType)])).parquet(
            f"{table}/{r['folder']}/parts").withColumn("_run", F.lit(k))
        rows, parts = (d, p) if rows is None else (rows.unionByName(d), parts.unionByName(p))
    return rows, parts


def _live(spark: SparkSession, table: str, content: dict, runs: list[dict] | None = None) -> DataFrame:
    """Of each partition the rows of the last of ``runs`` (all by default) that lists it."""
    runs = content["runs"] if runs is None else runs
    rows, parts = _runs(spark, table, content, runs)
    if len(runs) == 1:
        return rows.drop("_run")
    last = parts.groupBy("_p").agg(F.max("_run").alias("_last"))  # one row a partition
    return (rows.join(last, rows[content["partition"]].eqNullSafe(last["_p"]) & (rows["_run"] == last["_last"]))
            .drop("_p", "_last", "_run"))


def read_merged(spark: SparkSession, table: str, partition_col: str, version: int | None = None) -> DataFrame:
    """Rows of one version of the table, the last one by default."""
    _, content = Snapshots(spark, table).read(version)
    if content is None:
        raise FileNotFoundError(f"no version of {table}")
    assert content["partition"] == partition_col
    return _live(spark, table, content)


def _latest(batch: DataFrame, key: list[str], order_by: list[str] | None = None) -> DataFrame:
    """Of the rows with one key the greatest by ``order_by``, then by all columns."""
    rest = [c for c in batch.columns if c not in key]  # the key goes through the shuffle once
    by = [F.col(c).alias(f"_by{i}") for i, c in enumerate(order_by or [])]
    latest = F.max(F.struct(*by, *(rest or [F.lit(True).alias("_any")])))
    return batch.groupBy(*[F.col(c).alias(f"_key_{c}") for c in key]).agg(latest.alias("_r")).select(
        *[(F.col(f"`_key_{c}`") if c in key else F.col(f"_r.`{c}`")).alias(c) for c in batch.columns])


def _merge_batch(batch: DataFrame, batch_id: int, table: str, partition_col: str, key: list[str],
                 order_by: list[str] | None = None, fanout: int = FANOUT, min_age_s: float = MIN_AGE_S) -> None:
    """Bring the rows of ``batch`` into the table: a row replaces the stored row
    with its key, in whatever partition that one lies.

    The partitions of the batch's rows and those where its keys are stored are
    rebuilt in a new run.  Of several rows with one key in a batch the greatest
    by ``order_by``, then by all columns, counts.  The run is published with the
    batch's number, so a batch that is done again changes nothing."""
    spark = batch.sparkSession
    log = Snapshots(spark, table)
    version, content = log.read()
    if content is None:
        content = {"batch": -1, "runs": [], "partition": partition_col}
    if batch_id <= content["batch"]:
        return
    content["schema"] = batch.schema.json()
    folder = log.folder("run")
    runs = [folder]
    if not content["runs"]:
        # Written once in the order of its partitions; only rows whose key repeats go through a shuffle by the key.
        _write_run(batch, folder, partition_col)
        own = spark.read.schema(batch.schema).parquet(f"{folder}/data").select(*batch.columns)
        _write_parts(own, folder, partition_col)
        runs += _without_repeats(own, log, folder, partition_col, key, order_by)
    else:
        _latest(batch, key, order_by).write.parquet(f"{folder}/incoming")  # read several times below
        rows = spark.read.schema(batch.schema).parquet(f"{folder}/incoming")
        stored = _live(spark, table, content)
        where = _null_safe(stored.select(*dict.fromkeys([*key, partition_col])), rows.select(*key), key, "left_semi")
        touched = _write_parts(rows.select(partition_col).unionByName(where.select(partition_col)), folder, partition_col)
        kept = _null_safe(_null_safe(stored, touched, [partition_col], "left_semi"), rows.select(*key), key, "left_anti")
        _write_run(kept.unionByName(rows), folder, partition_col)
    content["batch"] = batch_id
    content["runs"] = content["runs"] + [{"folder": f.rsplit("/", 1)[1], "level": 0} for f in runs]
    version = log.publish(content, version)
    _compact(log, version, content, fanout)
    log.expire(min_age_s=min_age_s)


def _write_run(rows: DataFrame, folder: str, partition_col: str) -> None:
    rows.hint("rebalance", partition_col).write.partitionBy(partition_col).parquet(f"{folder}/data", compression="zstd")


def _write_parts(rows: DataFrame, folder: str, partition_col: str) -> DataFrame:
    """List the partitions of ``rows`` as those that the run replaces; returns them."""
    rows.select(F.col(partition_col).alias("_p")).distinct().coalesce(1).write.parquet(f"{folder}/parts")
    return rows.sparkSession.read.parquet(f"{folder}/parts").select(
        F.col("_p").cast(rows.schema[partition_col].dataType).alias(partition_col))


def _without_repeats(rows: DataFrame, log: Snapshots, folder: str, partition_col: str, key: list[str],
                     order_by: list[str] | None) -> list[str]:
    """Where a key repeats in ``rows``, a run in which the partitions of such rows hold the latest of each key only.

    Of all rows only a hash of the key is shuffled.  Keys that have it by chance are compared as a whole with the others."""
    hashed = rows.withColumn("_hash", F.xxhash64(*key))
    counted = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")
    counted.write.parquet(f"{folder}/repeated")
    repeated = rows.sparkSession.read.schema("_hash long").parquet(f"{folder}/repeated")
    if repeated.isEmpty():
        return []
    again = hashed.join(repeated, "_hash", "left_semi").drop("_hash")
    fixed = log.folder("run")
    touched = _write_parts(again.select(partition_col), fixed, partition_col)
    kept = _null_safe(hashed, touched, [partition_col], "left_semi").join(repeated, "_hash", "left_anti").drop("_hash")
    _write_run(kept.unionByName(_latest(again, key, order_by)), fixed, partition_col)
    return [fixed]


def _compact(log: Snapshots, version: int, content: dict, fanout: int) -> None:
    """While the last ``fanout`` runs are of one level, make one run of the next level of them."""
    while len(content["runs"]) >= fanout and len({r["level"] for r in content["runs"][-fanout:]}) == 1:
        before, last = content["runs"][:-fanout], content["runs"][-fanout:]
        folder = log.folder("run")
        _, parts = _runs(log.spark, log.path, content, last)
        parts.select("_p").distinct().coalesce(1).write.parquet(f"{folder}/parts")
        part = content["partition"]
        _write_run(_live(log.spark, log.path, content, last), folder, part)
        content["runs"] = before + [{"folder": folder.rsplit("/", 1)[1], "level": last[0]["level"] + 1}]
        version = log.publish(content, version)


def _null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    r = right.select(*[F.col(c).alias(f"__{c}") for c in on])
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(r[f"__{c}"])
    return left.join(r, cond, how)


def merge_stream(stream: DataFrame, table: str, partition_col: str, key: list[str], checkpoint: str,
                 mode: str = "append", available_now: bool = True, order_by: list[str] | None = None) -> StreamingQuery:
    """Keep ``table`` (read it with ``read_merged``) up to date with a stream
    of rows, of which a later one replaces an earlier one with the same key
    (within a batch: the greater one by ``order_by``)."""
    sink = partial(_merge_batch, table=table, partition_col=partition_col, key=key, order_by=order_by)
    w = (stream.writeStream.outputMode(mode).foreachBatch(lambda batch, i: sink(batch, i))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


# --- ST-1 -------------------------------------------------------------------------

def stream_session(spark: SparkSession, state_partitions: int) -> SparkSession:
    """A session for a stateful stream: a streaming aggregate fixes its number
    of state partitions when it first starts.  The clone shares the cluster
    but not the caller's settings."""
    s = spark.newSession()
    s.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    s.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return s


def kpi_upsert(events: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """ST-1: days that changed are replaced in a table partitioned by month."""
    kpis = daily_kpis(events).withColumn("month", C.month_start("day"))
    return merge_stream(kpis, table, "month", KPI_KEY, checkpoint, mode="update")


def stream_kpis_daily_batch_result(spark: SparkSession, sf_dir: str, state_partitions: int | None = None,
                                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Run ST-1 to completion over the files present and read the result.

    ``state_partitions``: by default the session's shuffle partitions."""
    base = scratch_path(spark, "stream_kpis_daily")
    table = os.path.join(base, "out")
    s = stream_session(spark, state_partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    kpi_upsert(event_stream(s, f"{sf_dir}/events.parquet", max_files_per_trigger), table,
               os.path.join(base, "checkpoint")).awaitTermination()
    return read_merged(spark, table, "month").drop("month")


def kpis_append(events: DataFrame, out: str, checkpoint: str, watermark: str = "1 day") -> StreamingQuery:
    """Append form: a day is written once, when the watermark has passed it
    (the days after that are still open when the stream ends)."""
    return (daily_kpis(events, watermark).writeStream.outputMode("append").format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


# --- ST-2, ST-3 ---------------------------------------------------------------------

def lineitem_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    from chainlens.sources.fixtures import TPCH_SCHEMAS
    return file_stream(spark, TPCH_SCHEMAS["lineitem"], path, max_files_per_trigger)


def alert_stream(orders_stream: DataFrame, lead_days: int = 14) -> DataFrame:
    """Stateless alert rows: order lines with lead time above the limit."""
    return orders_stream.where(F.col("lead_time_days") > lead_days).select(
        "order_id", "order_date", "ship_date", "lead_time_days",
        F.lit("high_lead_time").alias("alert"))


def stream_high_lead_alerts_batch_result(spark: SparkSession, sf_dir: str,
                                         max_files_per_trigger: int | None = None) -> DataFrame:
    """ST-2 over the test tables: lineitem arrives as a stream, is joined to
    the static order / customer / part tables, and lines with a lead time
    above the limit are appended to the alert sink.  Stateless, so every
    micro-batch's alerts are final; run to completion and read back."""
    from chainlens.sources import fixtures as FX
    stream = lineitem_stream(spark, f"{sf_dir}/lineitem.parquet", max_files_per_trigger)
    lines = FX.order_lines(FX.raw(spark, sf_dir), lineitem=stream)
    base = scratch_path(spark, "stream_high_lead_alerts")
    q = (alert_stream(lines).writeStream.format("parquet").outputMode("append")
         .option("path", os.path.join(base, "out"))
         .option("checkpointLocation", os.path.join(base, "checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "out"))


def fact_orders_refresh(lines: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """ST-3: order lines of a stream are shaped into fact rows and merged into
    the months that they touch; a line that comes again replaces the stored one."""
    from chainlens.plans import warehouse as W
    facts = (W.fact_orders(lines, keep=["supplier_id", "line_number"])
             .withColumn("order_month", C.month_start("order_date")))
    return merge_stream(facts, table, "order_month", LINE_KEY, checkpoint)


def stream_fact_orders_refresh_batch_result(spark: SparkSession, sf_dir: str,
                                            max_files_per_trigger: int | None = None) -> DataFrame:
    """ST-3 over the test tables, run to completion and read back."""
    from chainlens.sources import fixtures as FX
    stream = lineitem_stream(spark, f"{sf_dir}/lineitem.parquet", max_files_per_trigger)
    lines = FX.order_lines(FX.raw(spark, sf_dir), lineitem=stream)
    base = scratch_path(spark, "stream_fact_orders_refresh")
    table = os.path.join(base, "fact_orders")
    fact_orders_refresh(lines, table, os.path.join(base, "checkpoint")).awaitTermination()
    return read_merged(spark, table, "order_month").drop("supplier_id", "line_number")
