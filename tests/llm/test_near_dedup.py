import random

import numpy as np

from chainlens.llm import near_dedup as N
from llm_util import AWKWARD, prose, table


def sets(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, percent):
    s = [sets(t, width) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                parent[find(a)] = find(b)
    low = {}
    ids = [-(1 << 63) if r[0] is None else r[0] for r in rows]
    for k in range(len(rows)):
        low[find(k)] = min(low.get(find(k), 1 << 62), ids[k])
    return sorted([(r[0], len(s[k]), None if low[find(k)] == -(1 << 63) else low[find(k)], low[find(k)] == ids[k])
                   for k, r in enumerate(rows)], key=str)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(["alpha", "beta", "gamma", "delta", "omega" + str(rng.random())])
    return " ".join(w)


def rows_of():
    rng = random.Random(5)
    rows = list(AWKWARD)
    base = prose(rng, lines=6, words=25)
    for i in range(150):  # a large group of near copies, some too far from its centre
        rows.append((i, edited(rng, base, rng.randint(0, 9)), "en", "s"))
    for i in range(150, 200):
        t = prose(rng, lines=3, words=20)
        rows.append((i, t, "en", "s"))
        if i % 3 == 0:
            rows.append((1000 + i, t.upper(), "en", "s"))
        if i % 4 == 0:
            rows.append((2000 + i, edited(rng, t, 2), "en", "s"))
    rows.append((5000, "long " + " ".join(str(k) for k in range(60_000)), "en", "s"))
    return rows


def got(df, **kw):
    return sorted([(r["_id"], r["n"], r["component"], r["kept"]) for r in N.groups(df, **kw).collect()], key=str)


def test_equals_brute_force(spark):
    rows = rows_of()
    assert got(table(spark, rows), width=3, percent=85) == brute(rows, 3, 85)


def test_default_shingles(spark):
    rows = rows_of()
    assert got(table(spark, rows)) == brute(rows, 5, 80)


def test_sketch_estimates_similarity():
    a, b = N.hash_parameters()
    rng = np.random.default_rng(1)
    for j in (0.7, 0.85, 0.95):
        est = []
        for _ in range(60):
            common = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
            k = int(round(600 * (1 - j) / (2 * j)))
            x, y = (np.concatenate([common, rng.integers(0, 1 << 63, k, dtype=np.uint64)]) for _ in range(2))
            mx, my = N.minhash(x, a, b), N.minhash(y, a, b)
            bits = int(np.unpackbits((N.odd_sketch(mx) ^ N.odd_sketch(my)).view(np.uint8)).sum())
            assert bits <= 2 * int((mx != my).sum())
            est.append(1 + N.BITS / (4 * N.SAMPLES) * np.log(1 - 2 * bits / N.BITS))
        assert abs(np.mean(est) - j) < 0.02


def test_empty_and_stage(spark):
    docs = table(spark, rows_of())
    assert N.groups(docs.where("false")).count() == 0
    out = N.stage(spark, docs, "")
    assert out.columns == docs.columns
    want = {r[0] for r in brute(rows_of(), 5, 80) if r[3]}
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == want


def test_stage_keeps_one_row_of_repeated_ids_and_of_rows_without_one(spark):
    rng = random.Random(12)
    a, b, c, d = (prose(rng, lines=3, words=30) for _ in range(4))
    near = a + " tail"
    rows = [(5, a, "en", "s"), (5, a, "en", "s"), (9, near, "en", "s"),        # one group: a repeated row and a near copy
            (9, b, "en", "s"), (7, b, "en", "s"),                               # id 9 is in two groups
            (None, c, "en", "s"), (None, c, "en", "s"),                         # copies without an id
            (None, d, "en", "s"), (11, d, "en", "s")]
    got = sorted(((r["doc_id"], r["text"]) for r in N.stage(spark, table(spark, rows), "").collect()), key=str)
    assert got == sorted([(5, a), (7, b), (None, c), (11, d)], key=str)
