"""Session construction and the shared checkpoint / scratch location."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every chainlens job relies on.  AQE re-plans joins from runtime
# sizes (broadcast only when the measured side is below the threshold),
# coalesces small shuffle partitions and splits skewed join partitions.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str = "local[8]",
    shuffle_partitions: int = 8,
    app_name: str = "chainlens",
    driver_memory: str = "8g",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Local session for tests and the benchmark.

    On a cluster the session comes from the launcher; only ``BASE_CONF``
    matters there and ``shuffle_partitions`` should be sized to the data
    (about 128-256 MB of shuffle per partition).
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
    )
    for key, value in {**BASE_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(input_bytes: float, executors: int = 1000, cores_per_executor: int = 4,
                 target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a large cluster, sized from the bytes the biggest job reads.

    * initial shuffle partitions = input / target (at least 2 waves of tasks)
      so no shuffle partition has to spill heavily; AQE then coalesces small
      ones toward ``advisoryPartitionSizeInBytes``;
    * file splits of 512 MB keep scan tasks few but parallel;
    * skewed partitions (> 5x the median and > 1 GB) are split by AQE;
    * broadcast only below 64 MB measured at runtime (never a fact table).
    For 100 TB the input gives about 370,000 partitions of 256 MB.
    """
    slots = executors * cores_per_executor
    parts = max(2 * slots, int(input_bytes // target_partition_bytes) + 1)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(512 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1 << 30),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.parquet.aggregatePushdown": "true",
    }


def apply_conf(spark: SparkSession, conf: dict[str, str]) -> None:
    """Apply runtime SQL settings (e.g. ``cluster_conf``) to a session."""
    for k, v in conf.items():
        spark.conf.set(k, v)


def twin_session(spark: SparkSession, **more) -> SparkSession:
    """A session with the SQL settings of ``spark`` and ``more`` of them, which the caller's session does not get."""
    s = spark.newSession()
    for key, value in spark.sql("SET").collect():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            s.conf.set(key, value)
    apply_conf(s, more)
    return s


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Bytes of the files below the paths, from the file system's own summary."""
    conf = spark._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        total += path.getFileSystem(conf).getContentSummary(path).getLength()
    return total


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints, stream state and written tables.

    Taken from ``spark.checkpoint.dir`` (or the context's checkpoint dir).
    Where neither is set, a single-process session (``local[...]``, as in
    tests) gets a fresh folder; on a cluster that is an error, since a folder
    of one machine is not seen by the others.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="chainlens-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused sub-folder of the checkpoint root."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")
