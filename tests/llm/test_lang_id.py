import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from chainlens.llm import lang_id as G
from llm_util import AWKWARD, prose, table


def rows_of(n=240):
    rng = random.Random(7)
    rows = [(i, prose(rng, ("en", "de", "fr")[i % 3], lines=2), ("en", "de", "fr")[i % 3], "s") for i in range(n)]
    return rows + AWKWARD + [(800, prose(rng, "de", lines=3000), "de", "s"), (801, "abc", None, None)]


def brute_shares(bloom, text):
    """One trigram at a time over Python sets of bit positions."""
    t = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    grams = [t[i:i + 3] for i in range(len(t) - 2) if t[i + 1] != " "]
    hits = np.zeros(len(bloom.languages))
    for g in grams:
        code = np.array([(ord(g[0]) << 42) | (ord(g[1]) << 21) | ord(g[2])], dtype=np.uint64)
        mask = int(bloom.masks(code)[0][0])
        hits += [(mask >> i) & 1 for i in range(len(hits))]
    p = bloom.chance()
    return np.clip((hits / max(1, len(grams)) - p) / (1 - p), 0, 1)


def test_held_out_accuracy_and_defined_cases(spark):
    docs = table(spark, rows_of())
    out = G.identified(docs).withColumn("held", G.is_held_out(F.col("doc_id"))).collect()
    assert len(out) == docs.count()
    for r in out:
        if r["doc_id"] is not None:
            assert r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not any(map(str.isalpha, r["text"] or "")):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        assert 0 <= r["score"] <= 1
    held = [r for r in out if r["held"] and r["doc_id"] < 300]
    assert len(held) > 30 and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97


def test_shares_equal_one_by_one(spark, monkeypatch):
    bloom = G.train(table(spark, rows_of()))
    assert bloom.languages == ["de", "en", "fr"]
    texts = [t or "" for _, t, *_ in rows_of(30)][:41]
    letters = G.letter_table()
    want = np.array([brute_shares(bloom, t) for t in texts])
    assert np.allclose(bloom.shares(texts, letters), want)
    monkeypatch.setattr(G, "CHUNK", 64)  # texts longer than a chunk are met in slices
    assert np.allclose(bloom.shares(texts, letters), want)


def test_no_labels_and_empty(spark):
    docs = table(spark, [(i, t, None, s) for i, t, _, s in rows_of(20)])
    assert {r["lang_pred"] for r in G.identified(docs).collect()} == {"und"}
    assert G.identified(docs.where("false")).count() == 0


def test_stage(spark):
    docs = table(spark, rows_of())
    out = G.stage(spark, docs, "")
    assert out.columns == docs.columns
    ids = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert ids >= set(range(240)) and not ids & {900, 901, 902, 904}
