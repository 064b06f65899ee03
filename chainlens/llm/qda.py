"""Operator 13: quality by regularised quadratic discriminant analysis.

Each text gets a vector of transformed statistics.  The labelled rows give
each class a mean and a covariance; a covariance is shrunk towards the one
pooled over the classes, and then towards a multiple of the unit matrix.  A
document's score is the posterior probability of class 1: the logistic of the
difference of the classes' log densities, each a squared Mahalanobis distance
by the class's cached Cholesky factor and its determinant.

*Statistics* are counted per text by byte-level translation and word lists,
and are logs of ratios drawn towards usual values for short texts, so that
few words decide little.

*Training* adds up counts, sums and cross products per class over all
labelled rows: the statistics are written once, joined with the labels by id,
and a class comes to the driver as 1 + d + d * d numbers.  Scoring reads the
written statistics, not the texts.

Defined results: null or empty text has the statistics of no words and gets a
score like any other.  Labels of null id, null quality or other values are
not learned from; a document with several label rows counts once a label row.
Repeated rows each get a row.  Where a class has no labelled row every score
is the share of class 1 (0.5 without labels).  An empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.llm.common import sliced, table, written

THRESHOLD = 0.7
TO_POOLED = 0.1          # share of the pooled covariance in each class's
TO_UNIT = 0.02           # share of the unit matrix in it
SYMBOLS = b"#$%&*|<>\\^~@{}[]="
CALLS = b"!?"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = UPPER + b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
SENTENCE_END = re.compile(rb"[.!?][\"')\]]*(?=\s|$)")
DIM = 8


def statistics(text: str | None) -> list[float]:
    """The vector of a text."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    n, distinct = len(words), len(set(words))
    lines = [x for x in b.split(b"\n") if x.strip()]

    def count(chars: bytes) -> int:
        return len(b) - len(b.translate(None, chars))

    same = sum(map(bytes.__eq__, words, words[1:]))
    letters = count(LETTERS)
    return [
        math.log((count(SYMBOLS) + 0.5) / (len(b) + 100)),
        math.log((count(CALLS) + 0.5) / (len(b) + 100)),
        math.log((count(UPPER) + 3) / (letters + 100)),
        math.log((same + 0.5) / (n + 50)),
        math.log((distinct + 20) / (n + 20)),
        math.log(n + 10),
        math.log((len(b) - n + 120) / (n + 20)),
        math.log((len(SENTENCE_END.findall(b)) + 2) / (n + 20)),
    ]


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _x) per row of ``docs``."""
    def run(batches):
        for b in sliced(batches):
            x = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["_id", "_x"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string")).mapInArrow(
        run, "_id long, _x array<double>")


def moments(rows: DataFrame, dim: int = DIM) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Class -> count, sums and cross products of ``_x``, from rows (_class, _x)."""
    def add_up(batches):
        sums = {c: np.zeros((dim + 1, dim + 1)) for c in (0, 1)}
        for b in batches:
            c = np.asarray(b.column(0))
            x = np.hstack([np.ones((b.num_rows, 1)), np.asarray(b.column(1).flatten()).reshape(b.num_rows, dim)])
            for k, m in sums.items():
                m += x[c == k].T @ x[c == k]
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([m.ravel() for m in sums.values()],
                                                                                pa.list_(pa.float64()))], names=["k", "m"])

    size = (dim + 1) ** 2
    out = (rows.select(F.col("_class").cast("int"), "_x").mapInArrow(add_up, "k int, m array<double>")
           .groupBy("k").agg(F.array(*[F.sum(F.col("m")[i]) for i in range(size)]).alias("m")).collect())  # two rows
    found = {c: np.zeros((dim + 1, dim + 1)) for c in (0, 1)} | {r.k: np.array(r.m).reshape(dim + 1, dim + 1) for r in out}
    return {k: (m[0, 0], m[0, 1:], m[1:, 1:]) for k, m in found.items()}


class Discriminant:
    """Means, Cholesky factors and log determinants of two classes."""

    def __init__(self, found: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = TO_POOLED,
                 to_unit: float = TO_UNIT):
        n = {k: found[k][0] for k in (0, 1)}
        total = n[0] + n[1]
        self.share = n[1] / total if total else 0.5
        self.known = min(n.values()) > 0
        if not self.known:
            return
        self.mean = {k: found[k][1] / n[k] for k in (0, 1)}
        own = {k: found[k][2] / n[k] - np.outer(self.mean[k], self.mean[k]) for k in (0, 1)}
        pooled = sum(n[k] * own[k] for k in (0, 1)) / total
        self.inverse, self.log_det = {}, {}
        for k in (0, 1):
            cov = (1 - to_pooled) * own[k] + to_pooled * pooled
            scale = np.trace(cov) / len(cov)
            cov = (1 - to_unit) * cov + (to_unit * scale + 1e-9) * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.inverse[k] = np.linalg.inv(factor)  # of a triangle of a few rows
            self.log_det[k] = 2 * float(np.log(np.diag(factor)).sum())

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Posterior probability of class 1 for each row of ``x``."""
        if not self.known:
            return np.full(len(x), self.share)
        density = {k: -0.5 * ((((x - self.mean[k]) @ self.inverse[k].T) ** 2).sum(axis=1) + self.log_det[k]) for k in (0, 1)}
        odds = density[1] - density[0] + math.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def train(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", **shrinkage) -> Discriminant:
    """Learn from rows (_id, _x) and the labels 0 and 1 of their ids."""
    marks = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_class")).where(
        F.col("_class").isin(0, 1) & F.col("_id").isNotNull())
    return Discriminant(moments(rows.join(marks, "_id").select("_class", "_x")), **shrinkage)


def scored(rows: DataFrame, model: Discriminant) -> DataFrame:
    """(_id, _score) of rows (_id, _x)."""
    shared = rows.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        model = Discriminant.__new__(Discriminant)
        vars(model).update(shared.value)
        for b in batches:
            x = np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, DIM))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x))], names=["_id", "_score"])

    return rows.select("_id", "_x").mapInArrow(run, "_id long, _score double")


def op13_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(vectors(table(spark, sf_dir, "documents")), "qda_vectors")
    model = train(rows.where(~is_held_out(F.col("_id"))), table(spark, sf_dir, "labels"))
    return scored(rows, model).select(F.col("_id").alias("doc_id"), is_held_out(F.col("_id")).alias("held_out"),
                                      F.col("_score").alias("score"),
                                      F.when(F.col("_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
