import random
import zlib

import numpy as np
import pytest

from chainlens.llm import qda as Q
from llm_util import AWKWARD, prose, table

LABELS = "doc_id long, quality int, toxic int, extra string"


def corpus(n=600):
    """Prose, and four kinds of junk."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        t = prose(rng, rng.choice(["en", "de", "fr"]), lines=rng.randint(1, 6), words=rng.randint(6, 25))
        bad = i % 5 == 0
        if bad:
            w = t.split()
            t = [lambda: " ".join(x + "###" for x in w), lambda: " | ".join(w), lambda: " ".join(x.upper() + "!!" for x in w),
                 lambda: " ".join(x for x in w[:8] for _ in range(12))][i // 5 % 4]()
        rows.append((i, t, "en", "s"))
        if i % 3:
            labels.append((i, int(not bad), i % 2, "x"))
    return rows, labels


@pytest.fixture(scope="module")
def scored(spark):
    rows, labels = corpus()
    rows = rows + AWKWARD
    vectors = Q.written(Q.vectors(table(spark, rows)), "qda")
    model = Q.train(vectors.where(~Q.is_held_out(Q.F.col("_id"))),
                    spark.createDataFrame(labels + [(None, 1, 0, "x"), (2, None, 0, "x"), (4, 7, 0, "x")], LABELS))
    return rows, labels, model, Q.scored(vectors, model).collect()


def reference(x, y):
    """Densities with plain inverse and determinant."""
    n = [int((y == k).sum()) for k in (0, 1)]
    own = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    log = []
    for k in (0, 1):
        c = (1 - Q.TO_POOLED) * own[k] + Q.TO_POOLED * pooled
        c = (1 - Q.TO_UNIT) * c + Q.TO_UNIT * np.trace(c) / len(c) * np.eye(len(c))
        m = x[y == k].mean(0)
        log.append((m, np.linalg.inv(c), np.log(np.linalg.det(c)), np.log(n[k] / sum(n))))

    def score(v):
        d = [-0.5 * ((v - m) @ inv @ (v - m) + det) + prior for m, inv, det, prior in log]
        return 1 / (1 + np.exp(-np.clip(d[1] - d[0], -500, 500)))
    return score


def test_scores_equal_plain_algebra(scored):
    rows, labels, _, out = scored
    learned = [i for i, *_ in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    y = np.array([q for i, q, *_ in labels if i in set(learned)])
    text = {i: t for i, t, *_ in rows if i is not None and i < 900}
    x = np.array([Q.statistics(text[i]) for i in learned])
    score = reference(x, y)
    got = {r["_id"]: r["_score"] for r in out}
    for i, t in text.items():
        assert abs(got[i] - score(np.array(Q.statistics(t)))) < 1e-6


def test_held_out_accuracy(scored):
    rows, _, _, out = scored
    held = {i for i, *_ in rows if i is not None and i < 900 and zlib.crc32(str(i).encode()) % 4 == 2}
    got = {r["_id"]: r["_score"] >= Q.THRESHOLD for r in out}
    assert len(held) > 100
    assert np.mean([got[i] == bool(i % 5) for i in held]) > 0.97


def test_every_row_is_scored(scored):
    rows, _, _, out = scored
    assert len(out) == len(rows) and all(0 <= r["_score"] <= 1 for r in out)
    assert len([r for r in out if r["_id"] == 906]) == 2


def test_equal_texts_have_equal_scores(scored):
    _, _, _, out = scored
    by = {r["_id"]: r["_score"] for r in out}
    assert by[900] == by[901]


def test_one_class_or_no_label(spark):
    rows = Q.written(Q.vectors(table(spark, corpus(20)[0])), "qda")
    for labels, want in (([], 0.5), ([(i, 1, 0, "x") for i in range(10)], 1.0), ([(1, 0, 0, "x")], 0.0)):
        model = Q.train(rows, spark.createDataFrame(labels, LABELS))
        assert {r["_score"] for r in Q.scored(rows, model).collect()} == {want}


def test_constant_statistics_are_usable(spark):
    rows = Q.written(Q.vectors(table(spark, [(i, "same text", "en", "s") for i in range(6)])), "qda")
    model = Q.train(rows, spark.createDataFrame([(i, i % 2, 0, "x") for i in range(6)], LABELS))
    assert {round(r["_score"], 6) for r in Q.scored(rows, model).collect()} == {0.5}


def test_empty_table(spark):
    rows = Q.written(Q.vectors(table(spark, corpus(5)[0]).where("false")), "qda")
    model = Q.train(rows, spark.createDataFrame([(1, 1, 0, "x")], LABELS))
    assert Q.scored(rows, model).count() == 0
