"""Orders with returns as a join of two streams = the batch LEFT JOIN, for lines whose window is closed."""

from __future__ import annotations

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from chainlens.streaming import order_returns as R

ORDERS = "order_id string, line_number int, order_date date"
RETURNS = "order_id string, return_id string, return_date date"
START = dt.date(2024, 1, 1)


def _day(n):
    return START + dt.timedelta(days=n)


def _run(spark, root, orders, returns, window, delay):
    """``orders`` and ``returns`` are lists of batches; file k of both sides makes micro-batch k."""
    sides = []
    for name, ddl, batches in (("o", ORDERS, orders), ("r", RETURNS, returns)):
        path = os.path.join(root, name)
        for k, batch in enumerate(batches):
            spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(path)
            newest = max((os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")), key=os.path.getctime)
            os.utime(newest, (1_700_000_000 + 10 * k, 1_700_000_000 + 10 * k))  # the source takes files by their time
        sides.append((spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path),
                      spark.read.schema(ddl).parquet(path)))
    (os_, ob), (rs, rb) = sides
    joined = R.orders_with_returns(os_, rs, window, delay)
    q = R.write_stream(joined, os.path.join(root, "out"), os.path.join(root, "ck"))
    q.awaitTermination()
    got = spark.read.schema(joined.schema).parquet(os.path.join(root, "out"))
    whole = R.orders_with_returns(ob, rb, window, delay)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    return rows(got), rows(R.closed_lines(got, ob, rb, window, delay)), rows(R.closed_lines(whole, ob, rb, window, delay)), q


def test_late_shuffled_batches_equal_batch_join(spark, tmp_root):
    rng = random.Random(7)
    orders, returns = [], []
    for k in range(8):  # batch k holds the days 10k .. 10k + 9, each up to four days late
        orders.append([]), returns.append([])
    for n in range(160):
        day = rng.randrange(76)
        late = min(7, (day + rng.randrange(4)) // 10)
        for line in range(rng.randrange(1, 4)):
            orders[late].append((f"O{n}", line, _day(day)))
        for m in range(rng.choice([0, 0, 1, 2])):
            back = day + rng.randrange(-2, 16)  # before the order, in the window of 12 days and after it
            if 0 <= back < 76:
                returns[min(7, (back + rng.randrange(4)) // 10)].append((f"O{n}", f"R{n}-{m}", _day(back)))
    for k, (o, r) in enumerate(zip(orders, returns)):
        rng.shuffle(o), rng.shuffle(r)
        o.append((f"end{k}", 0, _day(min(75, 10 * k + 9))))
        r.append((f"none{k}", f"E{k}", _day(min(75, 10 * k + 9))))
    got, closed, expected, q = _run(spark, tmp_root, orders, returns, window=12, delay=5)
    assert closed == expected and len(expected) > 100
    assert any(r[3] is None for r in expected) and any(r[3] is not None for r in expected)
    assert len(got) == len(set(got))  # nothing twice


def test_state_is_freed(spark, tmp_root):
    batches = [[(f"O{k}-{i}", 0, _day(30 * k)) for i in range(20)] for k in range(6)]
    back = [[(f"none{k}", f"R{k}", _day(30 * k))] for k in range(6)]
    _, closed, expected, q = _run(spark, tmp_root, batches, back, window=5, delay=1)
    assert closed == expected and len(closed) == 100
    kept = sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"])
    assert kept <= 21  # the last batch; the other 100 lines are gone


def test_nulls_repeats_and_the_window_edges(spark, tmp_root):
    o = [("A", 1, _day(0)), ("A", 1, _day(0)), (None, 1, _day(0)), ("B", 1, None), ("C", 1, _day(0)), ("Z", 1, _day(60))]
    r = [("A", "R1", _day(5)), ("A", "R2", _day(6)), ("A", "R3", _day(0)), (None, "R4", _day(1)), ("B", "R5", _day(1)),
         ("C", "R6", None), ("Z", "R7", _day(60))]
    _, closed, expected, _ = _run(spark, tmp_root, [o], [r], window=5, delay=1)
    assert closed == expected
    assert sorted((x[0], x[3] or "") for x in closed) == [("A", "R1"), ("A", "R1"), ("A", "R3"), ("A", "R3"), ("C", "")]


def test_an_empty_side_closes_nothing(spark):
    o = spark.createDataFrame([("A", 1, _day(0))], ORDERS)
    r = spark.createDataFrame([], RETURNS)
    assert R.orders_with_returns(o, r).count() == 1
    assert R.closed_lines(R.orders_with_returns(o, r), o, r).count() == 0


def test_left_column_names_survive(spark):
    o = spark.createDataFrame([("A", 1, _day(0))], ORDERS).withColumn("note", F.lit("x"))
    r = spark.createDataFrame([("A", "R1", _day(1))], RETURNS).withColumn("note", F.lit("y"))
    assert R.orders_with_returns(o, r).columns == ["order_id", "line_number", "order_date", "note", "return_id", "return_date"]


def test_a_backlog_in_any_order_is_taken_by_its_days(spark, tmp_root):
    o = spark.range(6000).selectExpr("cast(id as string) as order_id", "1 as line_number", "date_add(date'2024-01-01', cast(id * 7919 % 600 as int)) as order_date")
    r = o.where("order_id % 3 = 0").selectExpr("order_id", "concat('R', order_id) as return_id", "date_add(order_date, cast(order_id % 8 as int)) as return_date")
    assert R.backlog_batches(10 * R.BATCH_ROWS, 600, 12, 5) == 10 and R.backlog_batches(10 * R.BATCH_ROWS, 40, 12, 5) == 2
    assert R.backlog_batches(0, 0) == 1
    streams = []
    for name, rows, day in (("o", o, "order_date"), ("r", r, "return_date")):
        R.land(rows, day, os.path.join(tmp_root, name), files=20)
        streams.append(R.backlog_stream(spark, rows.schema, os.path.join(tmp_root, name), files=2))
    joined = R.orders_with_returns(*streams, 12, 5)
    q = R.write_stream(joined, os.path.join(tmp_root, "out"), os.path.join(tmp_root, "ck"))
    q.awaitTermination()
    rows = lambda df: sorted((tuple(x) for x in R.closed_lines(df, o, r, 12, 5).collect()), key=str)
    got = rows(spark.read.schema(joined.schema).parquet(os.path.join(tmp_root, "out")))
    assert got == rows(R.orders_with_returns(o, r, 12, 5)) and len(got) > 5000
    assert max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]) < 3000  # 8000 in one batch


def test_the_registered_backlog_goes_in_several_batches(spark, monkeypatch):
    monkeypatch.setattr(R, "BATCH_ROWS", 1000)
    seen = []
    monkeypatch.setattr(R, "write_stream", lambda *a, _w=R.write_stream: seen.append(_w(*a)) or seen[-1])
    got = R.batch_result(spark, "/root/testdata/sf0.001", state_partitions=2).count()
    peak = max(s["numRowsTotal"] for p in seen[0].recentProgress for s in p["stateOperators"])
    assert got > 6000 and peak < 4000  # all 8,000 rows of both sides when they came in one batch


def test_lines_without_a_table_that_gives_nothing(spark, tmp_root):
    """Tables of which no column is taken are not joined, unless their keys repeat."""
    import shutil
    from chainlens.sources import fixtures as FX
    shutil.copytree("/root/testdata/sf0.001", tmp_root)
    lines, back = ["order_id", "line_number", "product_id", "customer_id", "state", "order_date", "sales", "order_value"], ["order_id", "return_id", "return_date"]
    scans = lambda df, name: f"{name}.parquet" in df._jdf.queryExecution().optimizedPlan().toString() + str(df.inputFiles())

    def same():
        t = FX.tables(spark, tmp_root)
        for got, whole, cols in ((FX.order_lines(t.raw, columns=lines), t.orders, lines), (FX.returns(t.raw, columns=back), t.returns, back)):
            assert got.schema.simpleString() == whole.select(cols).schema.simpleString()
            assert sorted(map(str, got.collect())) == sorted(map(str, whole.select(cols).collect()))
        return FX.order_lines(t.raw, columns=lines)

    plain = same()
    assert not scans(plain, "part") and not scans(plain, "customer") and scans(plain, "orders")
    t = FX.tables(spark, tmp_root)
    both = FX.order_lines(t.raw, columns=["order_id", "category", "country"])
    assert scans(both, "part") and scans(both, "customer")
    n = plain.count()
    for name, key in (("part", "p_partkey"), ("customer", "c_custkey")):  # a key twice, and two without one
        df = spark.read.parquet(f"{tmp_root}/{name}.parquet")
        df.union(df.orderBy(key).limit(1)).union(df.limit(2).withColumn(key, F.lit(None).cast("long"))).write.parquet(f"{tmp_root}/{name}2")
        shutil.move(f"{tmp_root}/{name}.parquet", f"{tmp_root}/{name}1")
        shutil.move(f"{tmp_root}/{name}2", f"{tmp_root}/{name}.parquet")
        n, before = same().count(), n
        assert n > before and scans(same(), name)


def test_files_of_a_backlog_are_zstd_and_old_state_goes(spark, monkeypatch):
    import pyarrow.parquet as pq
    bases, sessions = [], []
    monkeypatch.setattr(R, "scratch_path", lambda s, n, _f=R.scratch_path: bases.append(_f(s, n)) or bases[-1])
    monkeypatch.setattr(R, "stream_session", lambda *a, _f=R.stream_session: sessions.append(_f(*a)) or sessions[-1])
    assert R.batch_result(spark, "/root/testdata/sf0.001", state_partitions=2).count() > 6000
    for side in ("orders", "returns", "out"):
        files = [os.path.join(bases[0], side, f) for f in os.listdir(os.path.join(bases[0], side)) if f.endswith(".parquet")]
        assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files if pq.ParquetFile(f).metadata.num_rows} == {"ZSTD"}
    assert sessions[0].conf.get("spark.sql.streaming.stateStore.compression.codec") == "zstd"
    assert int(sessions[0].conf.get("spark.sql.streaming.minBatchesToRetain")) == R.KEPT_BATCHES
    assert spark.conf.get("spark.sql.streaming.stateStore.compression.codec") == "lz4"
