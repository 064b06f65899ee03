"""Operator 1: repeated lines, found with levelled sorted runs of line hashes.

Documents arrive in batches of descending ``doc_id``.  Each batch builds its
own *run*: one row per line hash with the number of documents that hold it
and the largest of them, hash-bucketed and sorted by the hash.  Before the
run is added it is merge-joined with the runs that are already there: a hash
that no earlier run holds is new (the anti-join), any other carries what was
seen before.  When ``fanout`` runs stand on one level they are merged into a
single run of the next level, so a batch never meets more than
``fanout * levels`` runs.  As batches descend, a hash's keeper (its largest
``doc_id``) is known as soon as the hash is first met.

A hash met in fewer than ``min_docs`` documents drops nothing.  When a batch
lifts it to ``min_docs``, the batch's own lines go and the earlier lines that
were waiting are taken back, all but the keeper's.

Hashes are 128 bits wide.  Line rows carry positions, not text, so the text
is shuffled once, when the positions meet their document again.

Defined results: null or empty text is one empty line.  A null id counts as
one document below all others.  Rows that share an id are one document when
documents are counted; each row is returned with its own lines.  Extra
columns are kept untouched.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.llm.common import WS, ascii_lower, doc_key, quantile_cuts, shuffle_width, written
from chainlens.session import scratch_path

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2
HOT_SHARE = 1000  # a hash with over 1/HOT_SHARE of all line rows is hot; there are at most HOT_SHARE of them

HASH = ["_h1", "_h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per (document, line hash): the positions of its lines, each
    with a hash of the row's whole text to tell rows of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = line_key(F.col("_line"))
    return (docs.select(doc_key(F.col(id_col)).alias("_d"), F.xxhash64(text).alias("_t"),
                        F.posexplode(_lines(F.col(text_col))).alias("_pos", "_line"))
            .where(F.length(key) >= min_chars)
            .select("_d", F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit("second"), key).alias("_h2"),
                    F.struct("_t", "_pos").alias("_at"))
            .groupBy("_d", *HASH).agg(F.collect_set("_at").alias("_at")))


class SortedRuns:
    """Levels of runs, each a table bucketed and sorted by line hash."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = shuffle_width(spark)
        self.levels: list[list[DataFrame]] = []
        self.batches: list[DataFrame] = []

    def _store(self, df: DataFrame, name: str) -> DataFrame:
        table = f"{name}_{uuid.uuid4().hex[:12]}"
        (df.repartition(self.buckets, *HASH).sortWithinPartitions(*HASH).write
         .bucketBy(self.buckets, *HASH).sortBy(*HASH)
         .option("path", scratch_path(self.spark, name)).saveAsTable(table))
        return self.spark.table(table)

    def known(self) -> DataFrame | None:
        """All levels merged: hash, documents so far, keeper."""
        runs = [r for level in self.levels for r in level]
        if not runs:
            return None
        every = runs[0]
        for r in runs[1:]:
            every = every.unionByName(r)
        return every.groupBy(*HASH).agg(F.sum("_n").alias("_n"), F.max("_top").alias("_top"))

    def add(self, rows: DataFrame, batch: int) -> None:
        """Join the batch's hashes with the runs, then add its own run."""
        own = rows.groupBy(*HASH).agg(F.count(F.lit(1)).alias("_n"), F.max("_d").alias("_top"))
        known = self.known()
        if known is None:
            met = own.withColumns({"_seen": F.lit(0).cast("long"), "_keeper": F.lit(None).cast("long")})
        else:
            met = own.join(known.select(*HASH, F.col("_n").alias("_was"), F.col("_top").alias("_keeper")),
                           HASH, "left").withColumn("_seen", F.coalesce("_was", F.lit(0))).drop("_was")
        run = self._store(met.withColumn("_b", F.lit(batch)), "line_run")
        self.batches.append(run)
        self._place(run.select(*HASH, "_n", "_top"), 0)

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) < self.fanout:
            return
        every = self.levels[level][0]
        for r in self.levels[level][1:]:
            every = every.unionByName(r)
        merged = self._store(every.groupBy(*HASH).agg(F.sum("_n").alias("_n"), F.max("_top").alias("_top")),
                             "line_level")
        self.levels[level] = []
        self._place(merged, level + 1)

    def verdicts(self, min_docs: int) -> DataFrame:
        """Per hash and batch where it reached ``min_docs``: the keeper, the
        batches it holds for (``_from`` to ``_to``) and the rows it will meet."""
        parts = []
        for b, run in enumerate(self.batches):
            full = run.where(F.col("_seen") + F.col("_n") >= min_docs).withColumn(
                "_keep", F.coalesce("_keeper", "_top"))
            first = F.col("_seen") < min_docs  # earlier lines were waiting
            parts.append(full.select(*HASH, "_keep", F.when(first, 0).otherwise(b).alias("_from"),
                                     F.lit(b).alias("_to"),
                                     (F.col("_n") + F.when(first, F.col("_seen")).otherwise(0)).alias("_meets")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                  min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(_d, _at): per document the (text hash, position) of every line that goes."""
    spark = docs.sparkSession
    rows = line_rows(docs, id_col, text_col, min_chars)
    rows = written(rows, "line_rows")
    total = rows.count()
    cuts = quantile_cuts(rows, "_d", batches)[::-1]
    batch = sum((F.when(F.col("_d") <= c, 1).otherwise(0) for c in cuts), F.lit(0))
    rows = rows.withColumn("_b", batch)

    runs = SortedRuns(spark, fanout)
    for b in range(len(cuts) + 1):
        top, low = (cuts[b - 1] if b else None), (cuts[b] if b < len(cuts) else None)
        mine = rows
        if top is not None:
            mine = mine.where(F.col("_d") <= top)
        if low is not None:
            mine = mine.where(F.col("_d") > low)
        runs.add(mine.select("_d", *HASH), b)

    verdicts = written(runs.verdicts(min_docs), "line_verdicts")
    # A hot hash would put all its line rows into one task.  At most
    # 2 * HOT_SHARE hashes can be hot, so these are broadcast.
    limit = max(1, total // HOT_SHARE)
    hot_keys = F.broadcast(verdicts.groupBy(*HASH).agg(F.sum("_meets").alias("_m"))
                           .where(F.col("_m") > limit).select(*HASH))

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        a, v = left.alias("a"), right.alias("v")
        on = ((F.col("a._h1") == F.col("v._h1")) & (F.col("a._h2") == F.col("v._h2"))
              & F.col("a._b").between(F.col("v._from"), F.col("v._to")) & (F.col("a._d") != F.col("v._keep")))
        return a.join(v, on).select("a._d", "a._at")

    gone = meet(rows, F.broadcast(verdicts.join(hot_keys, HASH, "left_semi"))).unionByName(
        meet(rows.join(hot_keys, HASH, "left_anti"), verdicts.join(hot_keys, HASH, "left_anti")))
    return gone.groupBy("_d").agg(F.flatten(F.collect_list("_at")).alias("_at"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """(_doc, _kept_text, _n_lines, _n_dropped): the whole row as a struct,
    its remaining text, its lines and how many of them went."""
    gone = dropped_lines(docs, id_col, text_col, **params).withColumnRenamed("_d", "_gone_d")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    text = F.coalesce(F.col("_doc")[text_col], F.lit(""))
    joined = rows.join(gone, doc_key(F.col("_doc")[id_col]) == F.col("_gone_d"), "left")
    mine = F.array_distinct(F.transform(
        F.filter(F.col("_at"), lambda e: e["_t"] == F.xxhash64(text)), lambda e: e["_pos"]))
    out = joined.withColumn("_lines", _lines(F.col("_doc")[text_col])).withColumn(
        "_out", F.when(F.col("_at").isNull(), F.array().cast("array<int>")).otherwise(mine))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_out"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n")
    return out.select("_doc", F.when(F.size("_out") == 0, text).otherwise(kept).alias("_kept_text"),
                      F.size("_lines").cast("long").alias("_n_lines"), F.size("_out").cast("long").alias("_n_dropped"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "_doc.doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.col("_kept_text"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the text loses its repeated lines; every row stays."""
    new = {"text": F.col("_kept_text"), "n_chars": F.length("_kept_text").cast("long")}
    return dedup_lines(docs).select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS d,
                  string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, d, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, count(DISTINCT d) AS n, max(d) AS top FROM k WHERE length(key) >= 20 GROUP BY key),
v AS (SELECT k.*, coalesce(g.n >= 3 AND g.top <> k.d, false) AS gone FROM k LEFT JOIN g USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM v GROUP BY rid
"""
