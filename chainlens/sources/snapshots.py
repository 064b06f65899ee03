"""Tables that are replaced as a whole while others read them.

A table is a folder with data folders that are written once and never changed,
and a log ``_versions`` of small JSON files.  A version names the data folders
that belong to it.  Writing a version means to write new data folders first and
then to publish the version by one rename; until then, and if the job dies,
readers see the version before.  A reader looks up a version once and reads its
folders, so a refresh meanwhile does not mix two versions.

Old versions and folders that no kept version names (also those of failed jobs)
go by age.  There is one writer a table at a time, as for any refresh job; a
second one that publishes the same number fails.  The file system must rename
files atomically (HDFS and local disks do).
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

LOG = "_versions"
KEEP = 2                 # versions kept whatever their age
MIN_AGE_S = 24 * 3600.0  # younger folders are left alone: a reader or a writer may be at work in them


class Snapshots:
    """The version log of the table at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        log = self._path(f"{self.path}/{LOG}")
        if not self._fs.exists(log):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int | None = None) -> tuple[int, dict | None]:
        """Number and content of a version, the last one by default; (0, None) for a table without any."""
        if version is None:
            version = max(self.versions(), default=0)
            if not version:
                return 0, None
        stream = self._fs.open(self._path(f"{self.path}/{LOG}/{version:012d}.json"))
        try:
            return version, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def folder(self, name: str = "data") -> str:
        """A fresh data folder."""
        return f"{self.path}/{name}-{uuid.uuid4().hex[:12]}"

    def publish(self, content: dict, after: int | None = None) -> int:
        """Make ``content`` the version that follows ``after`` (by default the last one)."""
        version = (max(self.versions(), default=0) if after is None else after) + 1
        target = self._path(f"{self.path}/{LOG}/{version:012d}.json")
        draft = self._path(f"{self.path}/{LOG}/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version} of {self.path} was published by another writer")
        return version

    def expire(self, keep: int = KEEP, min_age_s: float = MIN_AGE_S) -> list[str]:
        """Remove versions before the last ``keep`` and the data folders that none of the kept names,
        both once they are ``min_age_s`` old; returns the folders removed."""
        old = time.time() * 1000 - min_age_s * 1000
        kept = []
        versions = self.versions()
        for k, v in enumerate(versions):
            file = self._path(f"{self.path}/{LOG}/{v:012d}.json")
            if k < len(versions) - keep and self._fs.getFileStatus(file).getModificationTime() <= old:
                self._fs.delete(file, False)
            else:
                kept.append(json.dumps(self.read(v)[1]))
        gone = []
        for s in self._fs.listStatus(self._path(self.path)):
            name = s.getPath().getName()
            if name != LOG and s.isDirectory() and s.getModificationTime() <= old and not any(name in k for k in kept):
                self._fs.delete(s.getPath(), True)
                gone.append(name)
        return gone


def replace(df: DataFrame, path: str, keep: int = KEEP, min_age_s: float = MIN_AGE_S) -> int:
    """Create or replace the table at ``path`` by the rows of ``df``; returns the version."""
    log = Snapshots(df.sparkSession, path)
    before = max(log.versions(), default=0)
    folder = log.folder()
    df.write.parquet(folder)
    version = log.publish({"data": folder.rsplit("/", 1)[1], "schema": df.schema.json()}, before)
    log.expire(keep, min_age_s)
    return version


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of one version of a table written by ``replace``."""
    from pyspark.sql.types import StructType
    _, content = Snapshots(spark, path).read(version)
    if content is None:
        raise FileNotFoundError(f"no version of {path}")
    schema = StructType.fromJson(json.loads(content["schema"]))
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{content['data']}")


def replace_view(df: DataFrame, database: str, name: str, keep: int = KEEP) -> str:
    """Create or replace ``database.name``: the rows go to a table of their own, and the view of that
    name is pointed at it in one step of the catalog.  The last ``keep`` such tables stay."""
    spark = df.sparkSession
    stamp = f"{int(time.time() * 1000):015d}_{uuid.uuid4().hex[:6]}"
    table = f"{name}__v{stamp}"
    df.write.format("parquet").saveAsTable(f"{database}.{table}")
    present = {t.name: t.tableType for t in spark.catalog.listTables(database)}
    if present.get(name.lower(), present.get(name)) in ("MANAGED", "EXTERNAL"):  # of a time before versions
        spark.sql(f"DROP TABLE {database}.{name}")
    spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS SELECT * FROM {database}.{table}")
    for old in sorted(t for t in present if t.startswith(f"{name.lower()}__v"))[:-keep]:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{old}")
    return f"{database}.{table}"
