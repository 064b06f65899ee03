"""Tables replaced as a whole while others read them."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from chainlens.sources import snapshots as S


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_reader_keeps_its_version_while_the_table_is_replaced(spark, tmp_root):
    path = os.path.join(tmp_root, "mart")
    with pytest.raises(FileNotFoundError):
        S.read(spark, path)
    assert S.replace(spark.range(3).toDF("a"), path) == 1
    reader = S.read(spark, path)
    assert S.replace(spark.range(5).selectExpr("id AS a", "'x' AS b"), path) == 2
    assert rows(reader) == [(0,), (1,), (2,)] and rows(S.read(spark, path, 1)) == rows(reader)
    assert S.read(spark, path).columns == ["a", "b"] and S.read(spark, path).count() == 5
    # from its own old version
    S.replace(S.read(spark, path).withColumn("a", F.col("a") + 1), path)
    assert rows(S.read(spark, path).select("a")) == [(1,), (2,), (3,), (4,), (5,)]


def test_a_job_that_fails_leaves_the_old_version(spark, tmp_root):
    path = os.path.join(tmp_root, "mart")
    S.replace(spark.range(3).toDF("a"), path)
    with pytest.raises(Exception):
        S.replace(spark.range(3).selectExpr("raise_error('stop') AS a"), path)
    log = S.Snapshots(spark, path)
    spark.range(9).write.parquet(log.folder())  # killed between write and publish
    assert log.versions() == [1] and S.read(spark, path).count() == 3
    S.replace(spark.range(4).toDF("a"), path, min_age_s=0)
    assert S.read(spark, path).count() == 4 and S.read(spark, path, 1).count() == 3
    assert len([x for x in os.listdir(path) if x.startswith("data-")]) == 2


def test_two_writers_of_one_version(spark, tmp_root):
    log = S.Snapshots(spark, os.path.join(tmp_root, "mart"))
    assert log.publish({"who": 1}, after=0) == 1
    with pytest.raises(RuntimeError, match="another writer"):
        log.publish({"who": 2}, after=0)
    assert log.read() == (1, {"who": 1})
    assert not [x for x in os.listdir(os.path.join(log.path, S.LOG)) if x.startswith(".draft") and not x.endswith(".crc")]


def test_old_versions_go_by_age(spark, tmp_root):
    path = os.path.join(tmp_root, "mart")
    for k in range(4):
        S.replace(spark.range(k + 1).toDF("a"), path)
    log = S.Snapshots(spark, path)
    assert log.versions() == [1, 2, 3, 4]  # all of them are young
    time.sleep(1.1)
    assert len(log.expire(keep=2, min_age_s=0.5)) == 2 and log.versions() == [3, 4]
    assert S.read(spark, path, 3).count() == 3


def test_views_of_a_database(spark, tmp_root):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS snap_db LOCATION '{tmp_root}'")
    try:
        spark.range(2).write.saveAsTable("snap_db.m")  # a plain table of earlier days
        for n in (3, 4, 5, 6):
            S.replace_view(spark.range(n).toDF("a"), "snap_db", "m", keep=2)
            assert spark.table("snap_db.m").count() == n
        assert len([t for t in spark.catalog.listTables("snap_db") if t.name.startswith("m__v")]) <= 3
    finally:
        spark.sql("DROP DATABASE IF EXISTS snap_db CASCADE")
