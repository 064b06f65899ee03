"""Operator 5: mixing to target weights with soft domain membership.

*Domains.*  A naive Bayes classifier over hashed words, trained on a bounded
sample of the labelled table, gives each document posterior probabilities of
the domains (``high`` and ``low`` quality, ``toxic``).  Log ratios are
averaged to SOFT_WORDS words, so memberships stay soft for long texts.

*Rates.*  Document i with t_i words and posteriors p_i gets a rate r_i >= 0.
The rates minimise the squared distance between the expected domain totals
``sum r_i t_i p_i`` and the targets by projected gradient steps::

    e = sum r_i t_i p_i - target                  (one aggregate)
    r_i <- min(max(r_i - p_i . M^-1 e, 0), max_rate)

with M = sum t_i p_i p_i' over the documents that can still move, which makes
the unprojected step exact.  Only e and M (a few numbers) reach the driver;
a rate is a function of the document's posteriors and the steps so far, so
nothing is written between steps.

*Target.*  Weights are shares.  The domain of greatest weight keeps its own
expected total, the others are raised or lowered to go with it.

``copies`` is the rate rounded at random by a hash of the id and the text: its
expected value is the rate.  The pipeline stage rounds with the same expected
values, but one document after the other: within a hashed part of about
PART_DOCS documents, ordered by likeliest domain, a row gets the whole numbers
that its rate adds to the running sum from a hashed start.  So each domain's
copies in a part differ from the sum of its rates by less than one.

All steps are DataFrame operations.  The table of word weights has at most
BUCKETS rows and is broadcast.  Words are summed per document inside a task
before they are shuffled.

Defined results: null, empty or blank text has no words, the prior as its
posterior and the rate that follows.  Null ids are allowed, repeated rows
each get a row.  Without labels all domains are equally likely.  An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlens.llm.common import ascii_lower, table, words, written

DOMAINS = ("high", "low", "toxic")
TARGET = {"high": 0.93, "low": 0.05, "toxic": 0.02}
BUCKETS = 1 << 16
SAMPLE_DOCS = 20_000     # labelled documents to learn from, at most
SOFT_WORDS = 64
SMOOTHING = 200.0        # words by which each domain's rates are drawn to the overall ones
RARE = 20.0              # a bucket seen this often counts half
STEPS = 25
TOLERANCE = 1e-7
PART_DOCS = 4096         # documents of a part that are rounded one after the other


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when(quality == 1, "high")


def _features(text: Column) -> Column:
    """Distinct words of the text."""
    return F.array_distinct(words(ascii_lower(text)))


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def train(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...] = DOMAINS,
          sample: int = SAMPLE_DOCS) -> tuple[DataFrame, list[float]]:
    """(_b, _w0.._wk) log weights of at most BUCKETS word buckets, and log priors."""
    labelled = (labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("_domain"))
                .where(F.col("doc_id").isNotNull() & F.col("_domain").isNotNull()).dropDuplicates(["doc_id"])
                .orderBy(F.xxhash64(F.lit("sample"), "doc_id")).limit(sample))
    rows = (docs.select("doc_id", "text").join(F.broadcast(labelled), "doc_id")
            .select("_domain", F.explode(_features(F.col("text"))).alias("_word")))
    counts = written(rows.groupBy(_bucket(F.col("_word")).alias("_b")).agg(*[
        F.sum(F.when(F.col("_domain") == d, 1.0).otherwise(0.0)).alias(f"_c{k}") for k, d in enumerate(domains)]),
        "mix_counts")
    totals = counts.agg(*[F.coalesce(F.sum(f"_c{k}"), F.lit(0.0)) for k in range(len(domains))]).first()
    n = {r[0]: r[1] for r in labelled.groupBy("_domain").count().collect()}
    priors = [(n.get(d, 0) + 1) / (sum(n.values()) + len(domains)) for d in domains]
    every = sum(totals)
    rate = sum((F.col(f"_c{k}") for k in range(len(domains))), F.lit(0.0)) / max(every, 1.0)
    seen = sum((F.col(f"_c{k}") for k in range(len(domains))), F.lit(0.0))
    # Log of the domain's word rate over the overall rate, drawn towards 0 for rare words.
    weights = counts.select("_b", *[
        (F.log((F.col(f"_c{k}") / rate + SMOOTHING) / (totals[k] + SMOOTHING)) * seen / (seen + RARE)).alias(f"_w{k}")
        for k in range(len(domains))])
    return weights, priors


def posteriors(docs: DataFrame, weights: DataFrame, priors: list[float]) -> DataFrame:
    """(_row, _id, _text_hash, _t, _p0.._pk): words and domain probabilities of each row."""
    import math
    k = range(len(priors))
    key = ["_row", "_id", "_text_hash", "_t"]
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").alias("_id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text_hash"),
                       F.size(words(F.col("text"))).cast("double").alias("_t"), "text")
    rows = rows.select(*key, F.explode_outer(_features(F.col("text"))).alias("_word"))
    sums = (rows.select(*key, _bucket(F.col("_word")).alias("_b")).join(F.broadcast(weights), "_b", "left")
            .groupBy(*key).agg(F.count("_w0").alias("_n"), *[F.coalesce(F.sum(f"_w{i}"), F.lit(0.0)).alias(f"_s{i}")
                                                             for i in k]))
    scale = F.least(F.lit(1.0), F.lit(float(SOFT_WORDS)) / F.greatest(F.col("_n"), F.lit(1)))
    logs = [F.col(f"_s{i}") * scale + math.log(priors[i]) for i in k]
    d = sums.select(*key, *[x.alias(f"_l{i}") for i, x in enumerate(logs)])
    d = d.withColumn("_top", F.greatest(*[F.col(f"_l{i}") for i in k]))
    d = d.select(*key, *[F.exp(F.col(f"_l{i}") - F.col("_top")).alias(f"_e{i}") for i in k])
    total = sum((F.col(f"_e{i}") for i in k), F.lit(0.0))
    return d.select(*key, *[(F.col(f"_e{i}") / total).alias(f"_p{i}") for i in k])


def _solve(m: list[list[float]], v: list[float]) -> list[float]:
    """Gaussian elimination with pivots for the few domains."""
    n = len(v)
    a = [row[:] + [x] for row, x in zip(m, v)]
    for i in range(n):
        j = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[j] = a[j], a[i]
        for r in range(n):
            if r != i and a[i][i]:
                f = a[r][i] / a[i][i]
                a[r] = [x - f * y for x, y in zip(a[r], a[i])]
    return [a[i][n] / a[i][i] if a[i][i] else 0.0 for i in range(n)]


def _rate(steps: list[list[float]], max_rate: float | None) -> Column:
    r = F.lit(1.0)
    for g in steps:
        r = F.greatest(r - sum((F.col(f"_p{i}") * x for i, x in enumerate(g)), F.lit(0.0)), F.lit(0.0))
        if max_rate is not None:
            r = F.least(r, F.lit(max_rate))
    return r


def fit_rates(members: DataFrame, target: list[float], max_rate: float | None = None, steps: int = STEPS,
              tolerance: float = TOLERANCE) -> tuple[list[list[float]], list[float], list[float]]:
    """Steps of the projected gradient, the totals wanted and the totals reached."""
    k = range(len(target))
    t = F.col("_t")
    have = members.agg(*[F.coalesce(F.sum(t * F.col(f"_p{i}")), F.lit(0.0)) for i in k]).first()
    anchor = max(k, key=lambda i: target[i])
    budget = have[anchor] / target[anchor]
    wanted = [budget * x for x in target]
    if budget <= 0:
        return [], wanted, list(have)
    done: list[list[float]] = []
    slope = [0.0] * len(target)
    while True:
        r = _rate(done, max_rate)
        # A document at a bound is free only where the last step would move it inside.
        move = sum((F.col(f"_p{i}") * x for i, x in enumerate(slope)), F.lit(0.0))
        free = (F.col("_r") > 0) | (move < 0)
        if max_rate is not None:
            free = free & ((F.col("_r") < max_rate) | (move > 0))
        row = members.withColumn("_r", r).withColumn("_f", F.when(free, t).otherwise(0.0)).agg(
            *[F.sum(t * F.col("_r") * F.col(f"_p{i}")).alias(f"a{i}") for i in k],
            *[F.sum(F.col("_f") * F.col(f"_p{i}") * F.col(f"_p{j}")).alias(f"m{i}_{j}") for i in k for j in k]).first()
        reached = [row[f"a{i}"] for i in k]
        e = [reached[i] - wanted[i] for i in k]
        if len(done) >= steps or max(map(abs, e)) <= tolerance * sum(wanted):
            return done, wanted, reached
        m = [[row[f"m{i}_{j}"] + (1e-9 * have[i] if i == j else 0.0) for j in k] for i in k]
        slope = _solve(m, e)
        done.append(slope)


def mixed(docs: DataFrame, labels: DataFrame, target: dict[str, float] = TARGET,
          max_rate: float | None = None) -> DataFrame:
    """(_id, _text_hash, _t, _p*, _rate, _copies) per row of ``docs``."""
    domains = tuple(target)
    weights, priors = train(docs, labels, domains)
    members = written(posteriors(docs, weights, priors), "mix_members")
    steps, _, _ = fit_rates(members, [target[d] for d in domains], max_rate)
    u = F.pmod(F.xxhash64(F.lit("copies"), "_id", "_text_hash"), F.lit(1 << 30)) / float(1 << 30)
    return members.withColumn("_rate", _rate(steps, max_rate)).withColumn(
        "_copies", F.floor(F.col("_rate") + u).cast("long"))


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = mixed(docs, table(spark, sf_dir, "labels"))
    return out.select(F.col("_id").alias("doc_id"), F.col("_t").cast("long").alias("n_words"),
                      *[F.col(f"_p{i}").alias(f"p_{d}") for i, d in enumerate(TARGET)],
                      F.col("_rate").alias("rate"), F.col("_copies").alias("copies"))


def _uniform(*key: Column | str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / float(1 << 30)


def rounded(members: DataFrame, part_docs: int = PART_DOCS) -> DataFrame:
    """(_id, _text_hash, _times) per distinct document, with the rate as expected value of ``_times``."""
    parts = max(1, members.count() // part_docs)
    p = [c for c in members.columns if c.startswith("_p")]
    top = F.array_position(F.array(*p), F.greatest(*p))
    d = members.dropDuplicates(["_id", "_text_hash"]).select(
        "_id", "_text_hash", "_rate", top.alias("_top"),
        F.pmod(F.xxhash64(F.lit("part"), "_id", "_text_hash"), F.lit(parts)).alias("_part"))
    order = Window.partitionBy("_part").orderBy("_top", F.xxhash64(F.lit("order"), "_id", "_text_hash"), "_id", "_text_hash")
    d = d.withColumn("_sum", F.sum("_rate").over(order.rowsBetween(Window.unboundedPreceding, 0))
                     + _uniform(F.lit("start"), "_part"))
    before = F.coalesce(F.lag("_sum").over(order), _uniform(F.lit("start"), "_part"))
    return d.withColumn("_times", (F.floor("_sum") - F.floor(before)).cast("int")).select("_id", "_text_hash", "_times")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each row as often as its rounded rate says."""
    out = rounded(mixed(docs, table(spark, sf_dir, "labels")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    on = (F.col("_doc.doc_id").eqNullSafe(F.col("_id"))
          & (F.xxhash64(F.coalesce("_doc.text", F.lit(""))) == F.col("_text_hash")))
    return (rows.join(out, on).select("_doc", F.explode(F.array_repeat(F.lit(1), F.col("_times"))))
            .select("_doc.*"))
