import collections
import math
import random

import numpy as np

from chainlens.llm import mixing as M
from llm_util import AWKWARD, prose, table


def rows_of():
    rng = random.Random(11)
    rows, labels = list(AWKWARD), []
    for i in range(300):
        kind = i % 3
        t = prose(rng, lines=2, words=12)
        if kind == 0:
            t += " therefore evidence however"
        if kind == 1:
            t = " ".join(w + " ###" for w in t.split())
        if kind == 2:
            t += " stupid clown loser"
        rows.append((i, t, "en", "s"))
        if i % 2:
            labels.append((i, 0 if kind == 1 else 1, 1 if kind == 2 else 0))
    rows.append((640, "word " * 30_000, "en", "s"))
    return rows, labels + [(None, 1, 0), (5, None, None), (99999, 1, 1)]


def frames(spark):
    rows, labels = rows_of()
    return table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality long, toxic long")


def projected(t, p, target, steps=400):
    """The same projected gradient steps in numpy, run to convergence."""
    r = np.ones(len(t))
    slope = np.zeros(p.shape[1])
    for _ in range(steps):
        e = (t * r) @ p - target
        if np.abs(e).max() <= 1e-9 * target.sum():
            break
        free = (r > 0) | (p @ slope < 0)
        m = (p * (t * free)[:, None]).T @ p + 1e-9 * np.diag(t @ p)
        slope = np.linalg.solve(m, e)
        r = np.maximum(r - p @ slope, 0)
    return r


def test_rates_meet_the_targets(spark):
    docs, labels = frames(spark)
    out = M.mixed(docs, labels).toPandas()
    assert len(out) == docs.count()
    p = out[["_p0", "_p1", "_p2"]].to_numpy()
    assert np.allclose(p.sum(1), 1) and (out._rate >= 0).all()
    have = out._t.to_numpy() @ p
    want = np.array(list(M.TARGET.values())) * have[0] / M.TARGET["high"]
    reached = (out._t * out._rate).to_numpy() @ p
    assert np.abs(reached - want).max() <= 1e-4 * want.sum()
    assert np.allclose(out._rate, projected(out._t.to_numpy(), p, want, steps=M.STEPS), atol=1e-6)
    assert abs(out._copies - out._rate).max() < 1


def test_posteriors_equal_brute_force(spark):
    docs, labels = frames(spark)
    weights, priors = M.train(docs, labels)
    w = {r["_b"]: r for r in weights.collect()}
    got = collections.defaultdict(list)
    for r in M.posteriors(docs, weights, priors).collect():
        got[r["_id"]].append([r[f"_p{k}"] for k in range(3)])
    from pyspark.sql import functions as F
    words = docs.select("doc_id", F.transform(M._features(F.col("text")), M._bucket).alias("b")).collect()
    for r in words:
        known = [w[b] for b in r["b"] if b in w]
        scale = min(1.0, M.SOFT_WORDS / max(1, len(known)))
        logs = [math.log(priors[k]) + scale * sum(x[f"_w{k}"] for x in known) for k in range(3)]
        e = np.exp(np.array(logs) - max(logs))
        assert any(np.allclose(e / e.sum(), g) for g in got[r["doc_id"]])


def test_classifier_separates(spark):
    docs, labels = frames(spark)
    out = {r["_id"]: r for r in M.mixed(docs, labels).collect()}
    held = [i for i in range(0, 300, 2)]
    right = [max(range(3), key=lambda k: out[i][f"_p{k}"]) == (0, 1, 2)[i % 3] for i in held]
    assert np.mean(right) > 0.95


def test_bounds_no_labels_and_empty(spark):
    docs, labels = frames(spark)
    capped = M.mixed(docs, labels, target={"high": 0.2, "low": 0.7, "toxic": 0.1}, max_rate=1.5).toPandas()
    assert capped._rate.between(0, 1.5).all()
    none = M.mixed(docs, labels.where("false")).toPandas()
    assert len(none) == docs.count() and none._p0.between(0.33, 0.34).all()
    assert M.mixed(docs.where("false"), labels).count() == 0


def test_stage_keeps_good_rows_and_columns(spark, monkeypatch):
    docs, labels = frames(spark)
    monkeypatch.setattr(M, "table", lambda s, d, n: labels)
    out = M.stage(spark, docs, "")
    assert out.columns == docs.columns
    ids = collections.Counter(r["doc_id"] for r in out.select("doc_id").collect())
    good = [i for i in range(0, 300, 3)]
    assert sum(i in ids for i in good) >= 0.97 * len(good)
    assert sum(i in ids for i in range(2, 300, 3)) < 10


def test_stage_meets_the_target_totals(spark, monkeypatch):
    rng = random.Random(23)
    marks = ("therefore evidence however", "### ### menu", "stupid clown loser")
    rows = [(i, prose(rng, lines=2, words=12) + " " + marks[i % 3], "en", "s") for i in range(3000)]
    labels = spark.createDataFrame([(i, int(i % 3 != 1), int(i % 3 == 2)) for i in range(0, 3000, 2)],
                                   "doc_id long, quality long, toxic long")
    docs = table(spark, rows)
    monkeypatch.setattr(M, "table", lambda s, d, n: labels)
    members = M.mixed(docs, labels).toPandas().set_index("_id")
    p, t = members[["_p0", "_p1", "_p2"]], members["_t"]
    have = p.mul(t, axis=0).sum().to_numpy()
    want = np.array(list(M.TARGET.values())) * have[0] / M.TARGET["high"]
    ids = [r["doc_id"] for r in M.stage(spark, docs, "").select("doc_id").collect()]
    reached = p.loc[ids].mul(t.loc[ids], axis=0).sum().to_numpy()
    # Spread of the totals that rounding at random makes.
    frac = members["_rate"] % 1
    spread = np.sqrt((p.mul(t, axis=0) ** 2).mul(frac * (1 - frac), axis=0).sum().to_numpy())
    assert (np.abs(reached - want) <= 4 * spread + 1e-4 * want.sum()).all()
    assert (spread < want / 4).all()
    assert (reached[1:] > want[1:] / 2).all()
