import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np

from chainlens.llm import resampling as R
from chainlens.llm.common import written
from llm_util import AWKWARD, prose, table
from pyspark.sql import functions as F

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def runs(t):
    w = words(t)
    return [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def brute(docs, target, percent=5):
    s, t = (collections.Counter(bucket(f) for x in texts for f in runs(x)) for texts in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, text, *_ in docs:
        f = [bucket(x) for x in runs(text)]
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[:percent * len(able) // 100])}
    return collections.Counter((*r[:4], rank.get(id(r))) for r in out)


def rows_of(n=400):
    rng = random.Random(4)
    rows = list(AWKWARD) + [(i, prose(rng, rng.choice(["en", "de"]), lines=rng.randint(1, 5), words=rng.randint(3, 20)), "en", "s")
                            for i in range(n)]
    rows += [(2000 + i, rows[-1][1], "en", "s") for i in range(30)]
    rows += [(3000, "word-word_WORD 12é3 " * 3000, "en", "s"), (3001, "x" * 70_000 + " " + "日" * 900 + " b c", "en", "s"),
             (7, rows[20][1], "en", "s"), (3002, "a\x00b\x7fc " * 30, "en", "s")]
    return rows


def target_of(spark):
    rng = random.Random(9)
    texts = [prose(rng, "en") for _ in range(12)] + [None, ""]
    return texts, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def found(df):
    return collections.Counter(tuple(r) for r in df.select("_id", "_n_features", "_weight", "_score", "_rank").collect())


def test_equals_brute_force(spark):
    texts, target = target_of(spark)
    rows = rows_of()
    assert found(R.resampled(table(spark, rows).repartition(5), target)) == brute(rows, texts)


def test_many_ranges_give_the_same_ranks(spark):
    texts, target = target_of(spark)
    rows = rows_of()
    assert found(R.resampled(table(spark, rows), target, percent=40, range_rows=7)) == brute(rows, texts, 40)


def test_all_rows_drawn_and_equal_scores(spark):
    rows = written(spark.createDataFrame([(i, 20, 1, 1, 5) for i in range(50)] + [(None, 20, 1, 1, 5), (60, 20, 1, 1, 4)],
                                         "_id long, _n_words long, _n_features long, _weight long, _score long"), "ties")
    out = {r["_id"]: r["_rank"] for r in R.drawn(rows, 52, F.lit(True), range_rows=10).collect()}
    assert out == {**{i: i + 1 for i in range(50)}, None: 51, 60: 52}
    out = {r["_id"]: r["_rank"] for r in R.drawn(rows, 3, F.lit(True), range_rows=10).collect()}
    assert [i for i, k in out.items() if k] == [0, 1, 2]


def test_features_in_blocks_of_any_size():
    rng = random.Random(1)
    sums = R.Checksums()
    for trial in range(150):
        texts = ["".join(rng.choice("abcXYZ019 .,!\n\té日\x7f\x00_-") for _ in range(rng.choice([0, 1, 3, 20, 300])))
                 for _ in range(rng.randint(1, 6))]
        if trial % 10 == 0:
            texts.append("x" * rng.randint(60, 70) + " " + "y" * 200 + " b " + "é" * 40 + " c")
        got = [collections.Counter() for _ in texts]
        for doc, _, crc in R.features([t.encode() for t in texts], sums, block=rng.choice([1, 2, 3, 7, 1000])):
            for d, c in zip(doc, crc):
                got[d][int(c)] += 1
        assert got == [collections.Counter(zlib.crc32(f.encode()) for f in runs(t)) for t in texts]


def test_sample_resembles_the_target(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, "de" if i % 4 else "fr"), None, None) for i in range(400)]
    target = spark.createDataFrame([(prose(rng, "fr"),) for _ in range(40)], "text string")
    out = R.resampled(table(spark, rows), target, percent=20).where("_rank IS NOT NULL").collect()
    assert len(out) == 80 and np.mean([r["_id"] % 4 == 0 for r in out]) > 0.95


def test_empty_tables(spark):
    _, target = target_of(spark)
    docs = table(spark, rows_of(5))
    assert R.resampled(docs.where("false"), target).count() == 0
    assert R.resampled(docs, target.where("false")).count() == docs.count()
