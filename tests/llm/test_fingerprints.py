import hashlib
import random

import numpy as np

from chainlens.llm import fingerprints as P
from llm_util import AWKWARD, prose, table


def rows_of():
    rng = random.Random(17)
    rows = [(i * 3, prose(rng, lines=rng.randint(1, 5)), "en", "s") for i in range(120)]
    rows += [(9000, rows[5][1], "en", "s"), (9001, "w" * 300_000, "en", "s"), (9002, "lorem ipsum " * 40_000, "en", "s")]
    return rows + AWKWARD


def want(spark, rows):
    from pyspark.sql import functions as F
    tie = {r[0]: r[1] for r in spark.createDataFrame([(t or "",) for _, t, *_ in rows], "t string").distinct()
           .select("t", F.xxhash64("t")).collect()}
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], tie[r[1] or ""]))
    table_ = P.sample_table()
    out = []
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        edited = t[:len(t) - cut] + nxt[:cut]
        a, b, c = (P.signature(x, table_) for x in (t, edited, nxt))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(),
                    float(np.mean(a == b)), float(np.mean(a == c))))
    return sorted(out, key=str)


def test_equals_brute_force_over_any_ranges(spark):
    rows = rows_of()
    full = want(spark, rows)
    for size in (10, 4000):
        got = sorted([tuple(r) for r in P.fingerprinted(table(spark, rows), range_docs=size).collect()], key=str)
        assert got == full


def test_single_and_empty(spark):
    one = P.fingerprinted(table(spark, [(1, "abcd efgh", "en", "s")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest() and one["near_next"] == 1.0
    assert P.fingerprinted(table(spark, rows_of()).where("false")).count() == 0


def test_samples_follow_generalised_jaccard(monkeypatch):
    rng = np.random.default_rng(2)
    hits, want_ = [], []
    for _ in range(60):
        bucket = rng.choice(P.BUCKETS, 80, replace=False)
        x, y = rng.integers(0, 4, 80), rng.integers(0, 4, 80)
        best = []
        for w in (x, y):
            keep = w > 0
            best.append(P.packed_samples(bucket[keep], w[keep]).min(axis=0) & np.uint64(0xFFFFFFFF))
        hits.append(np.mean(best[0] == best[1]))
        want_.append(np.minimum(x, y).sum() / np.maximum(x, y).sum())
    assert abs(np.mean(hits) - np.mean(want_)) < 0.02


def test_weight_one_table_is_the_general_formula():
    text = " ".join(f"w{i}" for i in range(50)) + " w0 w1 w0 w1"
    bucket, weight = P.terms(text)
    least = P.packed_samples(bucket, weight).min(axis=0)
    code = (least & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    assert (P.signature(text, P.sample_table()) == ((code >> np.uint64(40)) % np.uint64(P.EMPTY)).astype(np.uint16)).all()


def test_long_texts_follow_their_true_term_sets():
    def text(lo, hi):
        return " ".join(f"w{i}" for i in range(lo, hi))
    n = 100_000
    whole = P.signature(text(0, n), P.sample_table())
    assert P.likeness(whole, P.signature(text(n, 2 * n), P.sample_table())) <= 2 / P.SAMPLES
    for shared in (0.5, 0.75, 0.95):
        start = int(n * (1 - shared))
        want_ = (n - start) / (n + start)
        got = P.likeness(whole, P.signature(text(start, n + start), P.sample_table()))
        assert abs(got - want_) <= 4 * np.sqrt(want_ * (1 - want_) / P.SAMPLES)


def test_variables_have_their_distributions():
    """A term of weight w is the least of n terms of weight 1 with probability w / (w + n)."""
    term = np.arange(40_000, dtype=np.uint64)
    a = P.packed_samples(term, np.where(term % 4 == 0, 3, 1)) >> np.uint64(32)
    wins = (a.reshape(-1, 4, P.SAMPLES).argmin(axis=1) == 0).mean()
    assert abs(wins - 0.5) < 0.005
