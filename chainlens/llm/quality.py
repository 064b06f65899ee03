"""Operator 2: quality rules by robust multivariate outliers.

Every text gets a vector of transformed statistics.  For each (language,
source) a minimum-covariance-determinant estimate gives a centre and a
covariance that junk cannot pull; a document whose Mahalanobis distance from
its group's centre is above a chi-square quantile is rejected, after the two
fixed base rules.

The estimate is the ``COVER`` share of rows whose covariance has the least
determinant.  It is looked for by concentration steps (keep that share of rows
nearest to the centre, take their mean and covariance, repeat), which never
raise the determinant.  There are three starts a group: medians and median
deviations; mean and covariance of all rows; and those of the half nearest to
the first.  All take ``FIRST_STEPS``; the one of least determinant goes on
until its determinant falls by less than ``TOLERANCE`` (of its logarithm) or
``STEPS`` are done.  The least one seen is kept, and a last step reweights with all
rows within the 97.5 % quantile.  Each step is two grouped aggregates over the
small table of statistics and joins with the written tables of estimates and
limits, which are broadcast while they are small: rows stay where they are, so a
group with a third of all rows does not meet in one task.  The linear algebra is
written out as column expressions (Cholesky factor and forward substitution),
so everything stays in DataFrame operations.

Groups of fewer than ``MIN_GROUP`` rows take their language's estimate, and
languages of fewer rows the estimate of the whole table.  A fixed ridge on
the diagonal keeps covariances of constant statistics usable.

Defined results: null, empty or blank text has no words and fails the base
rules.  Null language or source is a group of its own.  Repeated rows each
get a row.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.llm.common import WS_CLASS, words, written

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "[#*$%&|<>]"

COVER = 0.75
FIRST_STEPS = 2
STEPS = 20
TOLERANCE = 1e-6
MIN_GROUP = 200
CUTOFF = 0.999
# Least standard deviation of each transformed statistic.  Clean texts hold no
# symbols, so their spread is this ridge alone: the step from no symbol to one
# in a text of 1,400 characters, about the median.
FLOORS = (0.05, 0.025, 0.08, 0.06)
DIM = len(FLOORS)


def repeated_words(w: Column) -> Column:
    """Words inside a window of WINDOW words that occurs at least twice in the text."""
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    n = F.size(w)
    windows = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - WINDOW),
                    lambda i: F.xxhash64(*[F.get(F.col("_wh"), i + j) for j in range(WINDOW)])))
    return hashed, windows


def _covered(windows: Column) -> Column:
    """Positions covered by repeated windows: sort (hash, position), keep those
    with an equal neighbour, and add up the stretches they cover."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    both = F.transform(pairs, lambda p, k: F.when(
        (F.get(F.col("_pairs"), k - 1)["h"] == p["h"]) | (F.get(F.col("_pairs"), k + 1)["h"] == p["h"]), p["i"]))
    return pairs, F.sort_array(F.array_compact(both))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    and _n_lines (lines that hold a word), as ``_q_*`` columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashed, windows = repeated_words(F.col("_w"))
    d = (docs.withColumn("_w", words(F.col(text_col)))
         .withColumn("_q_n_words", F.size("_w").cast("long"))
         .withColumn("_q_word_chars", (F.length(text) - F.regexp_count(text, F.lit(WS_CLASS))).cast("long"))
         .withColumn("_q_n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
         .withColumn("_l", lines)
         .withColumn("_q_n_lines", F.size("_l").cast("long"))
         .withColumn("_q_n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
         .withColumn("_wh", hashed).withColumn("_win", windows))
    # Most texts repeat no window; only the others are sorted.
    d = d.withColumn("_some", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.col("_win")))
    pairs, _ = _covered(F.col("_some"))
    d = d.withColumn("_pairs", pairs)
    _, at = _covered(F.col("_some"))
    d = d.withColumn("_at", at)
    covered = F.aggregate(
        F.transform(F.col("_at"), lambda p, k: F.least(
            F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), k + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    return (d.withColumn("_q_n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
            .drop("_w", "_l", "_wh", "_win", "_some", "_pairs", "_at"))


def transformed() -> list[Column]:
    """The vector: mean word length, and shares of symbols, repeated lines and
    repeated words, each drawn towards its usual value for short texts and
    then put on a scale where its spread is even."""
    n, chars = F.col("_q_n_words"), F.col("_q_word_chars")
    return [F.log((chars + 5 * 30) / (n + 30)),
            F.sqrt(F.col("_q_n_symbols") / (chars + 200)),
            F.sqrt(F.col("_q_n_dup_lines") / (F.col("_q_n_lines") + 10)),
            F.sqrt(F.col("_q_n_repeat_words") / (n + 100))]


def chi2_cdf(x: float, dof: int) -> float:
    """Even degrees of freedom have a closed form."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < p else (low, mid)
    return high


def consistency(share: float) -> float:
    """Factor that makes the covariance of the nearest ``share`` of normal rows that of all."""
    return share / chi2_cdf(chi2_quantile(share, DIM), DIM + 2)


PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(f"_x{i}").alias(f"_m{i}") for i in range(DIM)],
        *[F.avg(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_p{i}{j}") for i, j in PAIRS])


FIT = ["_n", *[f"_m{i}" for i in range(DIM)], *[f"_l{i}{j}" for i, j in PAIRS]]


def _factor(moments: DataFrame, by: list[str], scale: float) -> DataFrame:
    """Mean and Cholesky factor of (scale * covariance + ridge) per group, and the logarithm of its determinant."""
    d = moments
    for i, j in PAIRS:
        c = F.col(f"_p{i}{j}") - F.col(f"_m{i}") * F.col(f"_m{j}")
        c = (F.greatest(c, F.lit(0.0)) * scale + FLOORS[i] ** 2) if i == j else c * scale
        d = d.withColumn(f"_c{i}{j}", c)
    for i, j in PAIRS:
        s = F.col(f"_c{i}{j}")
        for k in range(j):
            s = s - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
        d = d.withColumn(f"_l{i}{j}", F.sqrt(F.greatest(s, F.lit(FLOORS[i] ** 2 / 4))) if i == j
                         else s / F.col(f"_l{j}{j}"))
    return d.select(*by, *FIT, _log_det().alias("_det"))


def _log_det() -> Column:
    return F.round(2 * sum((F.log(f"_l{i}{i}") for i in range(1, DIM)), F.log("_l00")), 9)


def _distance(rows: DataFrame, fits: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """Squared Mahalanobis distance ``_d2`` by forward substitution."""
    d = rows.join(fits, by, how)
    total = F.lit(0.0)
    for i in range(DIM):
        s = F.col(f"_x{i}") - F.col(f"_m{i}")
        for j in range(i):
            s = s - F.col(f"_l{i}{j}") * F.col(f"_y{j}")
        d = d.withColumn(f"_y{i}", s / F.col(f"_l{i}{i}"))
        total = total + F.col(f"_y{i}") * F.col(f"_y{i}")
    return d.withColumn("_d2", total).drop(*[f"_y{i}" for i in range(DIM)], *FIT, "_det")


def _concentrated(rows: DataFrame, fits: DataFrame, by: str, cover: float) -> DataFrame:
    """One step for each start of each group: the fit of the ``cover`` share of rows nearest to it."""
    near = _distance(rows, fits, by)
    limit = written(near.groupBy(by, "_start").agg(F.percentile_approx("_d2", cover, 10000).alias("_limit")), "mcd_limit")
    inner = near.join(limit, [by, "_start"]).where(F.col("_d2") <= F.col("_limit"))
    return written(_factor(_moments(inner, [by, "_start"]), [by, "_start"], consistency(cover)), "mcd_step")


def _least(fits: DataFrame, by: str) -> DataFrame:
    """Each group's fit of least determinant, the first start among equals."""
    return fits.groupBy(by).agg(F.min_by(F.struct("_start", *FIT, "_det"), F.struct("_det", "_start")).alias("_f")).select(by, "_f.*")


def raw_fits(rows: DataFrame, by: str = "_g", cover: float = COVER, steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant estimate per group of ``by`` over ``_x0.._x3``, with ``_det``."""
    middle = written(rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), *[
        F.percentile_approx(f"_x{i}", 0.5, 10000).alias(f"_m{i}") for i in range(DIM)]), "mcd_middle")
    spread = rows.join(middle, by).groupBy(by).agg(F.first("_n").alias("_n"), *[
        F.first(f"_m{i}").alias(f"_m{i}") for i in range(DIM)], *[
        F.percentile_approx(F.abs(F.col(f"_x{i}") - F.col(f"_m{i}")), 0.5, 10000).alias(f"_s{i}") for i in range(DIM)])
    diagonal = spread.select(by, F.lit(0).alias("_start"), "_n", *[f"_m{i}" for i in range(DIM)], *[
        (F.sqrt(F.pow(1.4826 * F.col(f"_s{i}"), 2) + FLOORS[i] ** 2) if i == j else F.lit(0.0)).alias(f"_l{i}{j}")
        for i, j in PAIRS]).withColumn("_det", _log_det())
    diagonal = written(diagonal, "mcd_start")
    whole = _factor(_moments(rows, [by]), [by], 1.0).withColumn("_start", F.lit(1))
    half = _concentrated(rows, diagonal, by, 0.5).withColumn("_start", F.lit(2))
    fits = written(diagonal.unionByName(whole).unionByName(half), "mcd_starts")
    for _ in range(min(FIRST_STEPS, steps)):
        fits = _concentrated(rows, fits, by, cover)
    fits = least = written(_least(fits, by), "mcd_least")
    for _ in range(steps - FIRST_STEPS):
        after = _concentrated(rows, fits, by, cover)
        falls = after.select(by, F.col("_det").alias("_after")).join(fits, by).where(F.col("_det") - F.col("_after") > TOLERANCE)
        least = written(_least(least.unionByName(after), by), "mcd_least")
        if falls.isEmpty():
            break
        fits = after
    return least


def robust_fits(rows: DataFrame, by: str = "_g", cover: float = COVER, steps: int = STEPS) -> DataFrame:
    """The minimum-covariance-determinant estimate, reweighted."""
    inner = _distance(rows, raw_fits(rows, by, cover, steps), by).where(F.col("_d2") <= chi2_quantile(0.975, DIM))
    return written(_factor(_moments(inner, [by]), [by], consistency(0.975)), "mcd_fit")


def _level_key(*names: str) -> Column:
    parts = [F.coalesce(F.concat(F.lit("="), F.col(n).cast("string")), F.lit("-")) for n in names]
    return F.concat(F.lit(f"{len(names)}"), *[x for p in parts for x in (F.lit("\x01"), p)])


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
           min_group: int = MIN_GROUP, cutoff: float = CUTOFF, cover: float = COVER, steps: int = STEPS) -> DataFrame:
    """(_id, ``_q_*`` statistics, _base_failed, _d2, _kept) per row of ``docs``."""
    d = statistics(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"),
                               F.col(source_col).alias("_source")), "_text").drop("_text")
    n, rep = F.col("_q_n_words"), F.col("_q_n_repeat_words")
    d = d.withColumn("_base_failed", (n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n))
    for i, x in enumerate(transformed()):
        d = d.withColumn(f"_x{i}", x.cast("double"))
    d = d.withColumn("_g2", _level_key("_lang", "_source")).withColumn("_g1", _level_key("_lang")).withColumn(
        "_g0", _level_key())
    d = written(d, "doc_statistics")
    xs = [f"_x{i}" for i in range(DIM)]
    good = d.where(~F.col("_base_failed")).select("_g0", "_g1", "_g2", *xs)
    # Which level each document is judged at: its group's, if that is large enough.
    sizes = good.groupBy("_g0", "_g1", "_g2").agg(F.count(F.lit(1)).alias("_k"))
    langs = sizes.groupBy("_g1").agg(F.sum("_k").alias("_k1"))
    level = sizes.join(langs, "_g1").select(
        "_g2", F.when(F.col("_k") >= min_group, F.col("_g2")).when(F.col("_k1") >= min_group, F.col("_g1"))
        .otherwise(F.col("_g0")).alias("_g"))
    level = written(level, "mcd_level")
    used = level.select("_g").distinct()
    every = good.select(F.explode(F.array("_g0", "_g1", "_g2")).alias("_g"), *xs).join(used, "_g", "left_semi")
    fits = robust_fits(written(every, "mcd_rows"), "_g", cover, steps)
    out = _distance(d.join(level, "_g2", "left"), fits, "_g", "left")
    return (out.withColumn("_kept", ~F.col("_base_failed") & F.coalesce(
        F.col("_d2") <= chi2_quantile(cutoff, DIM), F.lit(False))).drop("_g", "_g0", "_g1", "_g2", *xs))


def op2_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged(docs).select(F.col("_id").alias("doc_id"), *[F.col(f"_q_{c}").alias(c) for c in base],
                               F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"),
                               F.col("_d2").alias("distance2"))
