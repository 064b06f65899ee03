"""Operator 11: audit of how filters interact, by incremental retraction streaming.

Five filters are judged for every document as bits of a mask; the last, E,
says that a smaller id has the same text.  How a filter does at any place of
any of the 120 orders follows from the number of documents with each mask, so
a counter a (part, mask, labels) is all that the audit keeps.

*Stream.*  The files of the table are processed as available-now
micro-batches.  A batch's rows get the bits that their own text decides (and
their labels, from the static table); equal rows of a task are added up; then
state keyed by the text (128 bits of its SHA-256) holds the smallest id met so
far and the counters that its rows went to.  When a smaller id arrives, these
rows are retracted from the mask without E and counted with E instead.  Rows
with a larger id are counted with E at once.  Texts share state in hashed
buckets of about BUCKET_DOCS documents, so that one call updates many of them.
So each batch emits signed changes of counters, and their sums are right after
every batch, in whatever order the files come.

*Recovery.*  State, offsets and commits lie in the checkpoint folder; a
batch's changes are written to a folder of its own number, which a batch that
is done again replaces.  The state store is the session's: the default one
keeps about 50 bytes a distinct text in the executors' memory, RocksDB
(``spark.sql.streaming.stateStore.providerClass``) on their disks.

*Skew.*  A task adds up the copies of a text before they are shuffled, so a
text that fills a third of the table arrives as a few rows a task.

*Counters.*  At most 32 masks and 4 label pairs a part.  From them the rows
of the 120 orders are computed by one projection per part.  A filter's
Shapley value times 120 is the sum of 120 / (filters failed) over the
documents that fail it.

Defined results: null text is the empty text, null language the part ''.  A
row without an id neither fails E nor makes another fail it.  Rows that repeat
an id and a text don't make each other fail.  A document with several label
rows is good or toxic if one of them says so.  An empty table has no parts and
gives an empty result.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chainlens.llm.common import table, words
from chainlens.session import scratch_path
from chainlens.streaming.kpis import file_stream, stream_session

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
LEAST_WORDS = 100
DISTINCT_PERCENT = 80
UPPER_PERCENT = 10
MARKS = "[#$%&*|]"

BATCHES = 4              # micro-batches of a run, about
HELD_ROWS = 100_000      # distinct rows that a task adds up before it passes them on
BUCKET_DOCS = 4096       # documents of a state bucket, about


def own_mask(text: Column) -> Column:
    """Bits of the filters A to D that the text fails."""
    t = F.coalesce(text, F.lit(""))
    w = words(t)
    conditions = [F.size(w) < LEAST_WORDS,
                  100 * F.size(F.array_distinct(w)) < DISTINCT_PERCENT * F.size(w),
                  100 * F.regexp_count(t, F.lit("[A-Z]")) > UPPER_PERCENT * F.length(t),
                  t.rlike(MARKS)]
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions)), F.lit(0)).cast("int")


def label_flags(labels: DataFrame) -> DataFrame:
    """(_label_id, _good, _toxic) of the documents that have one of both."""
    flags = labels.where((F.col("quality") == 1) | (F.col("toxic") == 1)).where(F.col("doc_id").isNotNull())
    return flags.groupBy(F.col("doc_id").alias("_label_id")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("_good"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("_toxic"))


# Rows of equal text, part, mask and labels: the smallest id, how many rows have it (0: none has an id), a larger one, none.
PARTIAL = "digest binary, part string, mask int, good int, toxic int, smallest long, at_smallest long, larger long, no_id long"
CELL = ["part", "mask", "good", "toxic"]


def partials(rows: DataFrame, held_rows: int = HELD_ROWS) -> DataFrame:
    """Rows (digest, part, mask, good, toxic, id) added up within each task."""
    def add_up(batches):
        sums: dict = {}

        def out():
            cols = list(zip(*[(*k, *v) for k, v in sums.items()]))
            kinds = [pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                              names=[c.split()[0] for c in PARTIAL.split(", ")])

        for b in batches:
            *key, ids = [c.to_pylist() for c in b.columns]
            for k, i in zip(zip(*key), ids):
                smallest, n, larger, none = sums.get(k, (0, 0, 0, 0))
                if i is None:
                    none += 1
                elif not n or i < smallest:
                    smallest, n, larger = i, 1, larger + n
                elif i == smallest:
                    n += 1
                else:
                    larger += 1
                sums[k] = (smallest, n, larger, none)
            if len(sums) >= held_rows:
                yield out()
                sums = {}
        if sums:
            yield out()

    return rows.mapInArrow(add_up, PARTIAL)


def changes(state: pd.DataFrame | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The state of some texts after the PARTIAL ``rows``, and the changes (CELL, n) of the counters.

    State: per text and cell the smallest id and the number of rows that have it."""
    met = rows[rows.at_smallest > 0]
    new = met[["digest", *CELL]].assign(id=met.smallest, n=met.at_smallest, known=False)
    every = new if state is None else pd.concat([state.assign(known=True), new], ignore_index=True)
    first = every.id == every.groupby("digest").id.transform("min")
    gone, late, fresh = every[every.known & ~first], every[~every.known & ~first], every[~every.known & first]

    def copies(of: pd.DataFrame) -> pd.DataFrame:
        return of.assign(mask=of["mask"] | COPY)

    moves = [fresh, copies(late), gone.assign(n=-gone.n), copies(gone),
             copies(rows.assign(n=rows.larger)), rows.assign(n=rows.no_id)]
    delta = pd.concat([m[[*CELL, "n"]] for m in moves]).groupby(CELL, as_index=False).n.sum()
    held = every[first].groupby(["digest", *CELL, "id"], as_index=False).n.sum()
    return held, delta[delta.n != 0]


def packed(state: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    held = pa.Table.from_pandas(state, preserve_index=False)
    with pa.ipc.new_stream(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(held)
    return sink.getvalue().to_pybytes()


def counter_changes(rows: DataFrame, buckets: int) -> DataFrame:
    """Signed changes (part, mask, good, toxic, n) of the counters, from a stream of PARTIAL rows."""
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else None
        held, delta = changes(held, pd.concat(frames))
        if len(held):
            state.update((packed(held),))
        yield delta

    keyed = rows.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))
    return keyed.groupBy("bucket").applyInPandasWithState(
        update, "part string, mask int, good int, toxic int, n long", "held binary", "append", GroupStateTimeout.NoTimeout)


def counters(spark: SparkSession, docs_path: str, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             part_col: str = "lang", batches: int = BATCHES,
             bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """(part, mask, good, toxic, n): documents of the table at ``docs_path`` with each mask,
    after all its files went through the stream."""
    files = spark.read.parquet(docs_path)
    base = scratch_path(spark, "filter_audit")
    s = stream_session(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    provider = "spark.sql.streaming.stateStore.providerClass"
    s.conf.set(provider, spark.conf.get(provider))
    per_batch = max(1, -(-len(files.inputFiles()) // batches))
    buckets = files.count() // bucket_docs + 1  # from the files' footers
    flags = os.path.join(base, "flags")
    label_flags(labels).write.parquet(flags)
    docs = file_stream(s, files.schema, docs_path, per_batch)
    rows = docs.select(
        F.substring(F.unhex(F.sha2(F.coalesce(text_col, F.lit("")), 256)), 1, 16).alias("digest"), F.coalesce(part_col, F.lit("")).alias("part"),
        own_mask(F.col(text_col)).alias("mask"), F.col(id_col).cast("long").alias("_id"))
    rows = rows.join(s.read.parquet(flags), F.col("_id") == F.col("_label_id"), "left").select(
        "digest", "part", "mask", F.coalesce("_good", F.lit(0)).alias("good"), F.coalesce("_toxic", F.lit(0)).alias("toxic"), "_id")
    out = os.path.join(base, "changes")

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy(*CELL).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{out}/_batch={number}")

    (counter_changes(partials(rows), buckets).writeStream.outputMode("append").foreachBatch(keep)
     .option("checkpointLocation", os.path.join(base, "checkpoint")).trigger(availableNow=True).start().awaitTermination())
    schema = "part string, mask int, good int, toxic int, n long"
    # Without a file there was no batch, and without a batch there is no folder.
    os_path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not os_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(os_path):
        return spark.createDataFrame([], schema)
    met = spark.read.schema(schema).parquet(*[f"{out}/{p.getPath().getName()}" for p in os_path.getFileSystem(
        spark._jsc.hadoopConfiguration()).listStatus(os_path)])
    return met.groupBy(*CELL).agg(F.sum("n").alias("n")).where("n != 0")


def audit(counts: DataFrame) -> DataFrame:
    """Counters -> one row a part, order and step."""
    cells = counts.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("g"), F.sum(F.col("n") * F.col("toxic")).alias("t"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "g", "t")).alias("_c"))  # 32 cells at most
    steps = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            steps.append(f"('{''.join(order)}', {k + 1}, {before}, {bit})")
            before |= bit
    spark = counts.sparkSession
    orders = spark.sql("SELECT collect_list(struct(*)) AS _s FROM VALUES " + ", ".join(steps)
                       + " AS t(filter_order, step, before, bit)").scalar()
    d = parts.select("part", "_c", F.explode(orders).alias("s")).select("part", "_c", "s.*")

    def total(of: str, cond, share: bool = False) -> Column:
        value = (lambda c: c[of] * 120 / F.bit_count(c["mask"]).cast("double")) if share else (lambda c: c[of])
        chosen = F.filter("_c", lambda c: cond(c["mask"]))
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda a, c: a + value(c).cast("long"))

    before, bit = F.col("before"), F.col("bit")
    fails = lambda m: m.bitwiseAND(bit) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~gone(m)
    return d.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"), total("n", lambda m: m == bit).alias("unique_fails"),
        total("g", here).alias("good_lost"), total("t", here).alias("toxic_lost"),
        total("n", fails, share=True).alias("shapley"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(counters(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels")))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce("text", '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
m AS (
  SELECT doc_id, part,
    CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM w),
f AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS g, sum(coalesce(toxic, 0)) AS t
      FROM m LEFT JOIN f USING (doc_id) GROUP BY part, mask),
p(filter_order, step, seen, bit) AS (
  SELECT x, 1, 0, CAST(1 << (strpos('ABCDE', x) - 1) AS INTEGER) FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x)
  UNION ALL
  SELECT filter_order || x, step + 1, seen | bit, CAST(1 << (strpos('ABCDE', x) - 1) AS INTEGER)
  FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE strpos(filter_order, x) = 0),
o AS (SELECT a.filter_order, b.step, b.seen, b.bit FROM p a JOIN p b ON starts_with(a.filter_order, b.filter_order)
      WHERE a.step = 5)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(sum(CASE WHEN mask & (seen | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN mask & seen = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN mask & seen <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN mask & seen = 0 AND mask & bit <> 0 THEN g ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN mask & seen = 0 AND mask & bit <> 0 THEN t ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN mask & bit <> 0 THEN n * 120 // bit_count(mask) ELSE 0 END) AS BIGINT) AS shapley
FROM c CROSS JOIN o GROUP BY part, filter_order, step
"""
