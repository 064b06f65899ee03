"""Stream = batch for the daily KPIs; stateless alert stream; incremental
partition refresh."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from conftest import SF_SMALL, inv_row, make_inventory, make_orders, order_row
from chainlens.functions import columns as C
from chainlens.sources.snapshots import Snapshots
from chainlens.streaming import kpis


def test_stream_equals_batch(spark):
    streamed = kpis.stream_kpis_daily_batch_result(spark, SF_SMALL)
    batch_events = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet")).withColumn(
        "ts", C.ntz_as_utc("ts"))
    batch = kpis.daily_kpis(batch_events)
    assert sorted(tuple(r) for r in streamed.collect()) == sorted(tuple(r) for r in batch.collect())


def test_stream_in_several_micro_batches(spark, tmp_root):
    src = os.path.join(tmp_root, "events_src")
    ev = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    ev.repartition(4).write.parquet(src)
    out, ck = os.path.join(tmp_root, "k_out"), os.path.join(tmp_root, "k_ck")
    q = kpis.kpi_upsert(kpis.event_stream(spark, src, max_files_per_trigger=1), out, ck)
    q.awaitTermination()
    assert len(Snapshots(spark, out).versions()) >= 4
    got = kpis.read_merged(spark, out, "month").drop("month")
    batch = kpis.daily_kpis(ev.withColumn("ts", C.ntz_as_utc("ts")))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in batch.collect())


def test_alert_stream_append(spark, tmp_root):
    src = os.path.join(tmp_root, "orders_src")
    o = make_orders(spark, [order_row("A", "2024-01-01", "2024-01-20"), order_row("B", "2024-01-01", "2024-01-02")])
    o.write.parquet(src)
    stream = spark.readStream.schema(o.schema).parquet(src)
    out, ck = os.path.join(tmp_root, "alerts_out"), os.path.join(tmp_root, "alerts_ck")
    q = (kpis.alert_stream(stream).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    assert [r["order_id"] for r in spark.read.parquet(out).collect()] == ["A"]


def _folders(spark, root, parts=4):
    """The test tables with events and lineitem as folders of several files."""
    import shutil
    os.makedirs(root, exist_ok=True)
    for name in os.listdir(SF_SMALL):
        if name not in ("events.parquet", "lineitem.parquet"):
            shutil.copy(os.path.join(SF_SMALL, name), root)
    for name in ("events", "lineitem"):
        spark.read.parquet(os.path.join(SF_SMALL, f"{name}.parquet")).repartition(parts).write.parquet(
            os.path.join(root, f"{name}.parquet"))
    return root


def _rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_folder_tables_one_file_a_trigger_equal_batch(spark, tmp_root):
    from chainlens.plans import warehouse as W
    from chainlens.sources import fixtures as FX
    root = _folders(spark, os.path.join(tmp_root, "folders"))
    orders = FX.tables(spark, SF_SMALL).orders
    facts = W.fact_orders(orders).withColumn("order_month", C.month_start("order_date"))
    got = kpis.stream_fact_orders_refresh_batch_result(spark, root, max_files_per_trigger=1)
    assert got.count() == orders.count() and _rows(got) == _rows(facts)
    alerts = kpis.stream_high_lead_alerts_batch_result(spark, root, max_files_per_trigger=1)
    assert _rows(alerts) == _rows(kpis.alert_stream(orders))
    days = kpis.stream_kpis_daily_batch_result(spark, root, max_files_per_trigger=1)
    events = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet")).withColumn("ts", C.ntz_as_utc("ts"))
    assert _rows(days) == _rows(kpis.daily_kpis(events))


def test_merge_replaces_by_key_and_replay_changes_nothing(spark, tmp_root):
    table = os.path.join(tmp_root, "merged")

    def rows(*values):
        return spark.createDataFrame(list(values), "month string, k int, v string")

    args = dict(table=table, partition_col="month", key=["month", "k"])
    kpis._merge_batch(rows(("m1", 1, "a"), ("m1", 2, "b"), ("m2", 1, "c"), (None, 9, "n")), 0, **args)
    second = rows(("m1", 2, "B"), ("m1", 3, "d"), (None, 9, "N"))
    kpis._merge_batch(second, 1, **args)
    want = [("m1", 1, "a"), ("m1", 2, "B"), ("m1", 3, "d"), ("m2", 1, "c"), (None, 9, "N")]
    read = lambda: sorted(((r["month"], r["k"], r["v"]) for r in
                           kpis.read_merged(spark, table, "month").collect()), key=str)
    assert read() == sorted(want, key=str)
    kpis._merge_batch(second, 1, **args)  # the batch is run again after a failure
    assert read() == sorted(want, key=str)
    kpis._merge_batch(rows(("m2", 5, "e")), 2, **args)
    assert read() == sorted(want + [("m2", 5, "e")], key=str)


def _state(spark, table):
    return sorted((tuple(r) for r in kpis.read_merged(spark, table, "month").select("k", "month", "v").collect()), key=str)


def test_a_key_that_changes_its_partition_leaves_no_old_row(spark, tmp_root):
    table = os.path.join(tmp_root, "moved")
    put = lambda i, *rows: kpis._merge_batch(
        spark.createDataFrame(list(rows), "k int, month string, v string"), i, table, "month", ["k"])
    put(0, (1, "jan", "a"), (2, "feb", "b"))
    put(1, (1, "feb", "A"))
    assert _state(spark, table) == [(1, "feb", "A"), (2, "feb", "b")]  # jan is empty now
    put(2, (2, None, "B"), (3, "jan", "c"))
    put(3, (2, "1999", "C"))
    assert _state(spark, table) == [(1, "feb", "A"), (2, "1999", "C"), (3, "jan", "c")]
    assert kpis.read_merged(spark, table, "month", version=1).count() == 2


def test_the_later_event_of_a_batch_counts(spark, tmp_root):
    table = os.path.join(tmp_root, "ordered")
    rows = [(1, "jan", "z", 1), (1, "feb", "a", 2), (2, "jan", "x", 1), (2, "jan", "y", 1)]
    for seed, name in ((1, "a"), (2, "b")):
        df = spark.createDataFrame(rows, "k int, month string, v string, t int").orderBy(F.rand(seed))
        kpis._merge_batch(df, 0, table + name, "month", ["k"], order_by=["t"])
        assert _state(spark, table + name) == [(1, "feb", "a"), (2, "jan", "y")]


def test_many_batches_leave_few_folders_and_equal_a_replay(spark, tmp_root):
    import random
    rng, table, want = random.Random(3), os.path.join(tmp_root, "levels"), {}
    n = 18
    for i in range(n):
        rows = [(rng.randrange(12), rng.choice(["a", "b", "c", None]), f"{i}-{j}") for j in range(3)]
        rows = list({r[0]: r for r in rows}.values())
        want.update({r[0]: r for r in rows})
        df = spark.createDataFrame(rows, "k int, month string, v string").coalesce(1)
        for _ in range(1 + (i % 7 == 0)):  # some batches are done twice
            kpis._merge_batch(df, i, table, "month", ["k"], fanout=3, min_age_s=0)
    assert _state(spark, table) == sorted(want.values(), key=str)
    runs = Snapshots(spark, table).read()[1]["runs"]
    assert len(runs) <= 2 * 3 and max(r["level"] for r in runs) == 2
    assert len([x for x in os.listdir(table) if x.startswith("run-")]) <= 2 * len(runs) + 3


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace
    import pytest
    from chainlens.session import checkpoint_root
    conf = SimpleNamespace(get=lambda k, d=None: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            checkpoint_root(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(
                getCheckpointDir=lambda: None, master=master)))


def test_append_mode_emits_only_closed_windows(spark, tmp_root):
    # files land in time order (one file per ten days), so no event is late
    src = os.path.join(tmp_root, "ev_append")
    ev = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    day = F.dayofmonth("ts")
    for lo, hi in [(1, 10), (11, 20), (21, 31)]:
        ev.where(day.between(lo, hi)).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    out, ck = os.path.join(tmp_root, "a_out"), os.path.join(tmp_root, "a_ck")
    kpis.kpis_append(kpis.event_stream(spark, src, max_files_per_trigger=1), out, ck, "1 hour").awaitTermination()
    got = {(r["day"], r["event_type"]): tuple(r) for r in spark.read.parquet(out).collect()}
    batch = {(r["day"], r["event_type"]): tuple(r) for r in
             kpis.daily_kpis(ev.withColumn("ts", C.ntz_as_utc("ts"))).collect()}
    assert got and set(got) < set(batch)             # the last day's windows are still open
    assert all(got[k] == batch[k] for k in got)      # closed windows are final and exact


def test_stream_days_do_not_depend_on_session_time_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        shifted = sorted(tuple(r) for r in kpis.stream_kpis_daily_batch_result(spark, SF_SMALL).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    utc = sorted(tuple(r) for r in kpis.stream_kpis_daily_batch_result(spark, SF_SMALL).collect())
    assert shifted == utc


def test_kpi_stream_state_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = kpis.stream_kpis_daily_batch_result(spark, SF_SMALL, state_partitions=3)
        assert out.count() == 150
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"  # caller's session untouched
        import glob
        from chainlens.session import checkpoint_root
        runs = sorted(glob.glob(os.path.join(checkpoint_root(spark), "stream_kpis_daily-*")), key=os.path.getmtime)
        state = os.path.join(runs[-1], "checkpoint", "state", "0")
        assert sorted(os.listdir(state)) == ["0", "1", "2"] or len(
            [d for d in os.listdir(state) if d.isdigit()]) == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_the_key_is_shuffled_once_for_the_latest_row(spark):
    import re
    df = spark.createDataFrame([("a", 1, 5, "x"), ("a", 1, 7, "w"), (None, 1, 2, "y"), (None, 1, 2, "z"), ("b", None, None, None)],
                               "k string, n int, v int, note string")
    got = kpis._latest(df, ["k", "n"], ["v"])
    assert got.columns == df.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("a", 1, 7, "w"), (None, 1, 2, "z"), ("b", None, None, None)]))
    assert sorted(map(tuple, kpis._latest(df.select("n").where("n = 1"), ["n"]).collect())) == [(1,)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"struct\([^)]*\b[kn]#", plan), plan


def test_only_rows_whose_key_repeats_are_shuffled_by_it(spark, tmp_root, monkeypatch):
    """The first batch is written once in the order of its partitions; of all rows only a hash of the key is shuffled."""
    seen, ddl = [], "k int, month string, v string"
    monkeypatch.setattr(kpis, "_latest", lambda batch, *a, _f=kpis._latest: seen.append(batch.count()) or _f(batch, *a))
    plain = spark.range(3000).selectExpr("cast(id as int) as k", "if(id % 7 = 0, null, concat('m', id % 3)) as month", "'a' as v")
    kpis._merge_batch(plain, 0, os.path.join(tmp_root, "plain"), "month", ["k"])
    assert not seen and _state(spark, os.path.join(tmp_root, "plain")) == sorted(map(tuple, plain.select("k", "month", "v").collect()), key=str)
    more = spark.createDataFrame([(5, "m9", "z"), (6, "m0", "b"), (6, None, "c"), (7, None, "A"), (None, "m1", "x"), (None, "m4", "y")], ddl)
    kpis._merge_batch(plain.union(more).repartition(5), 0, os.path.join(tmp_root, "more"), "month", ["k"])
    want = {r[0]: r for r in plain.select("k", "month", "v").collect()}
    # the greatest by all other columns, month first; a NULL is the least
    want |= {5: (5, "m9", "z"), 6: (6, "m0", "b"), 7: (7, None, "a"), None: (None, "m4", "y")}
    assert _state(spark, os.path.join(tmp_root, "more")) == sorted(map(tuple, want.values()), key=str)
    assert sum(seen) == 9  # two rows of 5, three of 6, two of 7, two without a key
    kpis._merge_batch(spark.createDataFrame([(6, "m2", "w")], ddl), 1, os.path.join(tmp_root, "more"), "month", ["k"])
    want[6] = (6, "m2", "w")
    assert _state(spark, os.path.join(tmp_root, "more")) == sorted(map(tuple, want.values()), key=str)
