"""Pages by position and multi-column clustering, against the sorted or filtered rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from chainlens.operators import dashboard as D
from chainlens.sources import clustered, ranks


def _rows(spark, n=4000, seed=3):
    rng = random.Random(seed)
    rows = [(i if i % 97 else None, rng.choice(["a", "b", "c", None]), dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(90)),
             rng.choice([rng.uniform(0, 100), float("nan")]) if i % 50 == 0 else rng.uniform(0, 100),
             f"C{rng.randrange(500):04d}", f"P{rng.randrange(500):04d}") for i in range(n)]
    return spark.createDataFrame(rows, "id long, kind string, day date, value double, customer string, product string").repartition(7)


KEY = ["kind", "day", "customer", "product", "value", "id"]


def test_pages_equal_the_sorted_slice(spark, tmp_root):
    df = _rows(spark)
    ranks.build(df, tmp_root, KEY, rows_per_range=300)
    pages = ranks.Pages(spark, tmp_root)
    want = [tuple(map(str, r)) for r in df.orderBy(*KEY).collect()]
    assert pages.total() == len(want) and pages.ranges.count() > 10
    for offset, limit in ((0, 10), (None, 5), (299, 3), (1234, 700), (3600, 50), (3990, 50), (4000, 5), (9999, 5), (3900, None), (0, None)):
        got = [tuple(map(str, r)) for r in pages.page(offset, limit).collect()]
        at = offset or 0
        assert got == want[at:at + limit if limit else None], (offset, limit)
    ranked = {r["rank"]: tuple(map(str, r))[:-1] for r in pages.page(2000, 20, with_rank=True).collect()}
    assert ranked == dict(enumerate(want[2000:2020], 2000))


def test_a_deep_page_opens_few_files(spark, tmp_root):
    df = _rows(spark)
    ranks.build(df, tmp_root, KEY, rows_per_range=300)
    pages = ranks.Pages(spark, tmp_root)
    page = pages.page(3600, 50)
    assert len(page.inputFiles()) <= 2 < len(spark.read.parquet(pages.data).inputFiles())
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "__position" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_pages_of_an_old_version_stay(spark, tmp_root):
    df = _rows(spark, 500)
    ranks.build(df, tmp_root, KEY, rows_per_range=100)
    old = ranks.Pages(spark, tmp_root)
    want = old.page(400, 20).collect()
    ranks.build(df.where("id > 250"), tmp_root, KEY, rows_per_range=100)
    assert list(map(str, old.page(400, 20).collect())) == list(map(str, want))
    assert ranks.Pages(spark, tmp_root).total() == df.where("id > 250").count()


def test_pages_of_empty_and_equal_rows(spark, tmp_root):
    df = _rows(spark, 10)
    ranks.build(df.where("false"), f"{tmp_root}/none", KEY)
    none = ranks.Pages(spark, f"{tmp_root}/none")
    assert none.total() == 0 and none.page(0, 5).collect() == [] and none.page(3).collect() == []
    same = spark.createDataFrame([(1, "x")] * 50, "a long, b string")
    ranks.build(same, f"{tmp_root}/same", ["a", "b"], rows_per_range=10)
    assert ranks.Pages(spark, f"{tmp_root}/same").page(45, 10).count() == 5
    with pytest.raises(FileNotFoundError):
        ranks.Pages(spark, f"{tmp_root}/absent")
    assert D.page(same, ["a", "b"], 10, 45).count() == 5


def test_running_sums_over_blocks(spark):
    n = 3 * ranks.BLOCK + 5
    counts = spark.range(n).selectExpr(f"cast(id as int) as {ranks.RANGE}", "id % 7 as rows")
    total = 0
    for r in ranks._running(counts).orderBy(ranks.RANGE).collect():
        assert r["first"] == total
        total += r["rows"]


BOUNDS = [dict(product=("P0100", "P0110")), dict(customer=("C0042", "C0042")), dict(day=(dt.date(2024, 2, 1), None), product=(None, "P0050")),
          dict(value=(99.0, None)), dict(kind=("b", "b")), dict(product=("Q", None)), dict(id=(10, 20), customer=(None, None)), {}]


def test_filters_through_zones_equal_the_plain_filter(spark, tmp_root):
    df = _rows(spark)
    clustered.build(df, tmp_root, ["day", "customer", "product"], zone_cols=["value", "kind"], rows_per_file=60, bits=5)
    table = clustered.Clustered(spark, tmp_root)
    assert table.rows().count() == df.count()
    for bounds in BOUNDS:
        cond = " and ".join(["true"] + [f"{c} is not null" + (f" and {c} >= '{lo}'" if lo is not None else "")
                                        + (f" and {c} <= '{hi}'" if hi is not None else "") for c, (lo, hi) in bounds.items()])
        want = sorted(map(str, df.where(cond).collect()))
        assert sorted(map(str, table.where(**bounds).collect())) == want, bounds


def test_second_and_third_columns_skip_files(spark, tmp_root):
    df = _rows(spark, 12000)
    clustered.build(df, f"{tmp_root}/z", ["day", "customer", "product"], rows_per_file=60, bits=5)
    table = clustered.Clustered(spark, f"{tmp_root}/z")
    files = table.zones.count()
    assert files > 100
    for bounds in (dict(product=("P0100", "P0105")), dict(customer=("C0042", "C0042"))):
        assert len(table.where(**bounds).inputFiles()) * 3 < files, bounds
    # a plain sort by the same columns opens nearly all files for the third
    df.repartitionByRange(files, "day", "customer", "product").write.parquet(f"{tmp_root}/sorted")
    hit = spark.read.parquet(f"{tmp_root}/sorted").groupBy("_metadata.file_name").agg({"product": "min", "customer": "count"})
    assert hit.where("`min(product)` <= 'P0105'").count() * 3 > 2 * files


def test_leading_column_and_odd_tables(spark, tmp_root):
    df = _rows(spark, 3000).selectExpr("*", "trunc(day, 'month') as month")
    clustered.build(df, f"{tmp_root}/m", ["customer", "product"], leading=["month"], rows_per_file=50, bits=4)
    table = clustered.Clustered(spark, f"{tmp_root}/m")
    march = dt.date(2024, 3, 1)
    in_month = len(table.where(month=(march, march)).inputFiles())
    assert in_month < table.zones.count() / 2
    assert len(table.where(month=(march, march), product=("P0100", "P0105")).inputFiles()) * 2 < in_month
    clustered.build(df.where("false"), f"{tmp_root}/none", ["customer", "product"])
    assert clustered.Clustered(spark, f"{tmp_root}/none").where(customer=("C0001", None)).collect() == []
    nulls = df.selectExpr("cast(null as string) as a", "cast(null as date) as b", "id")
    clustered.build(nulls, f"{tmp_root}/nulls", ["a", "b"])
    table = clustered.Clustered(spark, f"{tmp_root}/nulls")
    assert table.rows().count() == 3000 and table.where(a=(None, "z")).count() == 0
    with pytest.raises(ValueError):
        clustered.z_number({str(i): [1] for i in range(11)}, 6)


def test_the_part_of_a_value_is_found_by_halving(spark):
    values = {"a": [2, 5, 9, 14, 20], "b": [0.5, 1.5]}
    df = spark.createDataFrame([(a, b) for a in [None, *range(23)] for b in (None, -1.0, 0.5, 1.0, 7.0, float("nan"))], "a long, b double")
    got = df.withColumn("z", clustered.z_number(values, 3))
    for r in got.collect():
        parts = [0 if r[c] is None else sum(v <= r[c] or r[c] != r[c] for v in values[c]) for c in ("a", "b")]
        assert r["z"] == sum((p >> b & 1) << (2 * b + 1 - k) for k, p in enumerate(parts) for b in range(3))
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()  # was a pass over all cuts for each bit
