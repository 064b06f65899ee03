import collections
import random
import re

import numpy as np

from chainlens.llm import quality as Q
from llm_util import AWKWARD, prose, table


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(win)
    covered = {i + j for i, x in enumerate(win) if n[x] > 1 for j in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)), len(lines)


def vector(stats, n_lines):
    n, chars, sym, dup, rep = stats
    return [np.log((chars + 150) / (n + 30)), np.sqrt(sym / (chars + 200)), np.sqrt(dup / (n_lines + 10)), np.sqrt(rep / (n + 100))]


FLOORS = np.array(Q.FLOORS)


def low(v, p):
    return np.sort(v)[max(0, int(np.ceil(p * len(v))) - 1)]


def dist(x, mid, cov):
    return np.einsum("ij,jk,ik->i", x - mid, np.linalg.inv(cov), x - mid)


def fit(x, scale):
    return x.mean(0), np.cov(x.T, bias=True) * scale + np.diag(FLOORS ** 2)


def log_det(f):
    return np.linalg.slogdet(f[1])[1]


def concentrate(x, f, cover=Q.COVER):
    d = dist(x, *f)
    return fit(x[d <= low(d, cover)], Q.consistency(cover))


def raw_mcd(x):
    """Three starts, and steps until the determinant stops falling, in numpy."""
    mid = np.array([low(c, 0.5) for c in x.T])
    mad = np.array([low(abs(c - m), 0.5) for c, m in zip(x.T, mid)])
    diagonal = mid, np.diag((1.4826 * mad) ** 2 + FLOORS ** 2)
    fits = []
    for f in (diagonal, fit(x, 1.0), concentrate(x, diagonal, 0.5)):
        for _ in range(Q.FIRST_STEPS):
            f = concentrate(x, f)
        fits.append(f)
    f = min(fits, key=lambda f: round(log_det(f), 9))
    while True:
        after = concentrate(x, f)
        if log_det(f) - log_det(after) <= Q.TOLERANCE:
            return min(f, after, key=lambda f: round(log_det(f), 9))
        f = after


def mcd(x):
    near = x[dist(x, *raw_mcd(x)) <= Q.chi2_quantile(0.975, 4)]
    return fit(near, Q.consistency(0.975))


def rows_of():
    rng = random.Random(3)
    rows = list(AWKWARD)
    for i in range(500):
        lang = "en" if i % 3 else "de"
        t = prose(rng, lang, lines=rng.randint(1, 6), words=rng.randint(5, 30))
        if i % 25 == 0:
            t = " ".join(w + "***" for w in t.split())
        if i % 40 == 1:
            t = t + "\n" + t
        rows.append((i, t, lang, "hot"))
    rows += [(700, "word " * 40_000, "en", "hot"), (701, "Same line again here\n" * 50, "fr", "rare")]
    return rows


def test_statistics_and_base_rules(spark):
    rows = rows_of()
    out = Q.judged(table(spark, rows)).collect()
    got = collections.Counter((r["_id"], r["_q_n_words"], r["_q_word_chars"], r["_q_n_symbols"], r["_q_n_dup_lines"],
                               r["_q_n_repeat_words"], r["_base_failed"]) for r in out)
    want = collections.Counter()
    for i, t, *_ in rows:
        s, _ = base(t)
        want[(i, *s, s[0] < 10 or 100 * s[4] > 20 * s[0])] += 1
    assert got == want


def test_distances_equal_brute_force_mcd(spark):
    rows = rows_of()
    got = {r["_id"]: r for r in Q.judged(table(spark, rows)).collect()}
    for lang in ("en", "de"):
        own = [(i, *base(t)) for i, t, l, s in rows if l == lang and s == "hot"]
        own = [(i, s, k) for i, s, k in own if not (s[0] < 10 or 100 * s[4] > 20 * s[0])]
        if len(own) < Q.MIN_GROUP:
            continue
        x = np.array([vector(s, k) for _, s, k in own])
        m, c = mcd(x)
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        for (i, _, _), want in zip(own, d):
            assert abs(got[i]["_d2"] - want) <= 1e-6 * max(1, want)
            assert got[i]["_kept"] == (want <= Q.chi2_quantile(Q.CUTOFF, 4))


def test_no_random_start_finds_a_smaller_determinant(spark):
    rng = np.random.default_rng(11)
    groups = {"plain": rng.normal(size=(300, 4)) * 0.3,
              "spoilt": np.vstack([rng.normal(size=(240, 4)) * 0.1, 3 + rng.normal(size=(60, 4)) * 0.02]),
              "two clouds": np.vstack([rng.normal(size=(180, 4)) * [0.1, 0.5, 0.1, 0.1], 1 + rng.normal(size=(120, 4)) * 0.3]),
              "correlated": rng.normal(size=(250, 1)) @ np.array([[1.0, 0.8, -0.5, 0.2]]) + rng.normal(size=(250, 4)) * 0.05,
              "constant": np.zeros((50, 4))}
    rows = spark.createDataFrame([(g, *map(float, x)) for g, xs in groups.items() for x in xs],
                                 "_g string, _x0 double, _x1 double, _x2 double, _x3 double")
    got = {r["_g"]: r["_det"] for r in Q.raw_fits(rows).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert abs(got[g] - log_det(raw_mcd(x))) < 1e-5, g
        for _ in range(100):
            f = fit(x[rng.choice(len(x), 5, replace=False)], 1.0)
            for _ in range(30):
                f = concentrate(x, f)
            assert got[g] <= log_det(f) + 0.01, g  # near-equal subsets of an even cloud differ by less


def test_a_groups_rows_do_not_meet_in_one_task(spark):
    """Joins with the tables of estimates move no rows of the statistics."""
    from chainlens.llm.common import written
    rows = written(spark.range(1000).selectExpr("'a' as _g", *[f"rand({i}) as _x{i}" for i in range(4)]), "mcd_test_rows")
    fits = Q.raw_fits(rows)
    plan = Q._distance(rows, fits, "_g")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_junk_goes_and_prose_stays(spark):
    got = {r["_id"]: r["_kept"] for r in Q.judged(table(spark, rows_of())).collect()}
    rows = {i: t for i, t, *_ in rows_of() if i is not None and i < 500}
    clean = [i for i, t in rows.items() if i % 25 and i % 40 != 1 and len(t.split()) >= 10]
    assert all(got[i] for i in clean)
    assert not any(got[i] for i in rows if i % 25 == 0 and len(rows[i].split()) > 15)


def test_menus_and_sparse_symbols_go_and_a_stray_symbol_stays(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, lines=rng.randint(1, 6), words=rng.randint(12, 30)), "en", "hot") for i in range(500)]
    for i in range(0, 500, 10):
        rows[i] = (i, " | ".join(rows[i][1].split()[:rng.randint(12, 60)]), "en", "hot")
    for i in range(1, 500, 50):
        rows[i] = (i, " ".join(w + "#" * (k % 6 == 0) for k, w in enumerate(rows[i][1].split() * 3)), "en", "hot")
        rows[i] = (i, " ".join(dict.fromkeys(rows[i][1].split())), "en", "hot")
    for i in range(2, 500, 50):
        rows[i] = (i, rows[i][1] + " R&D", "en", "hot")
    got = {r["_id"]: r["_kept"] for r in Q.judged(table(spark, rows)).collect()}
    assert not any(got[i] for i in range(0, 500, 10))
    heavy = [i for i in range(1, 500, 50) if rows[i][1].count("#") > 0.1 * len(rows[i][1].split()) and len(rows[i][1]) > 200]
    assert heavy and not any(got[i] for i in heavy)
    assert all(got[i] for i in range(2, 500, 50))


def test_empty(spark):
    assert Q.judged(table(spark, rows_of()).where("false")).count() == 0
