import collections
import itertools
import random
import re

import pandas as pd
import pyarrow as pa

from chainlens.llm import filter_audit as A
from chainlens.session import scratch_path
from llm_util import AWKWARD, SCHEMA, prose, table

LABELS = "doc_id long, quality int, toxic int"


def rows_of():
    rng = random.Random(11)
    rows = list(AWKWARD)
    texts = [prose(rng, lang, lines=rng.randint(1, 12), words=rng.randint(5, 25)) for lang in ("en", "de") for _ in range(12)]
    texts += ["SHOUTED WORDS " * 60, "same " * 300, "a & b", "x " * 40_000, "| ".join(texts[:3])]
    for i in range(160):
        rows.append((i, rng.choice(texts), rng.choice(["en", "de", None, ""]), "s"))
    rows += [(1000 - i, texts[0], "en", "hot") for i in range(60)]                  # one large group of copies
    rows += [(3, texts[1], "de", "s"), (3, texts[1], "en", "s"), (None, texts[0], "en", "s"), (None, None, "fr", "s")]
    return rows


def labels_of(rng):
    out = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 160, 2)]
    return out + [(0, 1, 0), (0, 0, 1), (None, 1, 1), (900, 1, 1), (5000, 1, 1)]


def brute(rows, labels):
    smallest = {}
    for i, t, *_ in rows:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    masks = collections.defaultdict(list)
    for i, t, lang, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and smallest[t] < i}
        own = [x for x in labels if x[0] == i and i is not None]
        masks[lang or ""].append(({f for f in fails if fails[f]}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = set()
    for part, docs in masks.items():
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for fails, *_ in docs:
                first = next((f for f in order if f in fails), None)
                shapley[first] += 1
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                there = [d for d in docs if not d[0] & set(order[:k])]
                here = [d for d in there if f in d[0]]
                out.add((part, "".join(order), k + 1, len(there) - len(here), len(here),
                         sum(f in d[0] and bool(d[0] & set(order[:k])) for d in docs), sum(d[0] == {f} for d in docs),
                         sum(d[1] for d in here), sum(d[2] for d in here), shapley[f]))
    return out


def audited(spark, rows, labels, parts, **kw):
    """The audit of a table written as ``parts`` files in the order of the rows."""
    path = scratch_path(spark, "audit-docs")
    size = -(-len(rows) // parts) if rows else 1
    for k in range(parts):
        table(spark, rows[k * size:(k + 1) * size]).coalesce(1).write.mode("append").parquet(path)
    out = A.audit(A.counters(spark, path, spark.createDataFrame(labels, LABELS), **kw))
    return {tuple(r) for r in out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                                         "good_lost", "toxic_lost", "shapley").collect()}


def test_smaller_ids_in_later_files_retract_masks(spark):
    rows = sorted(rows_of(), key=lambda r: -(r[0] or 0))  # ids fall from batch to batch
    labels = labels_of(random.Random(5))
    want = brute(rows, labels)
    got = audited(spark, rows, labels, 4, batches=4, bucket_docs=20)
    assert got == want
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_one_batch_equals_many(spark):
    rows, labels = rows_of(), labels_of(random.Random(6))
    random.Random(1).shuffle(rows)
    assert audited(spark, rows, labels, 3, batches=1) == brute(rows, labels)


def test_changes_add_up_in_any_order():
    rng = random.Random(2)
    for _ in range(100):
        rows = [(rng.choice([b"t", b"u", b"v"]), rng.choice("pq"), rng.choice([0, 1]), 0, rng.choice([0, 1]),
                 rng.choice([None, 1, 2, 3, 4])) for _ in range(rng.randint(1, 12))]
        least = {}
        for t, *_, i in rows:
            if i is not None:
                least[t] = min(least.get(t, i), i)
        want = collections.Counter((p, m | (A.COPY if i is not None and i > least[t] else 0), g, x) for t, p, m, g, x, i in rows)
        state, got = None, collections.Counter()
        while rows:
            k = rng.randint(1, len(rows))
            batch, rows = rows[:k], rows[k:]
            state, delta = A.changes(state, pd.DataFrame(
                [(*c, i or 0, int(i is not None), 0, int(i is None)) for *c, i in batch],
                columns=[c.split()[0] for c in A.PARTIAL.split(", ")]))
            state = pa.ipc.open_stream(A.packed(state)).read_pandas()
            for *c, n in delta.itertuples(index=False):
                got[tuple(c)] += n
        assert {c: n for c, n in got.items() if n} == dict(want)


def test_tasks_add_up_copies(spark):
    rows = table(spark, [(i, "copy", "en", "s") for i in range(5000)]).coalesce(2)
    keyed = rows.selectExpr("unhex(sha2(text, 256)) AS digest", "lang AS part", "1 AS mask", "0 AS good", "0 AS toxic", "doc_id")
    out = A.partials(keyed).collect()
    assert len(out) <= 2 and sum(r["at_smallest"] + r["larger"] for r in out) == 5000


def test_empty_table(spark):
    path = scratch_path(spark, "audit-empty")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    out = A.audit(A.counters(spark, path, spark.createDataFrame([], LABELS)))
    assert out.count() == 0 and out.columns[:3] == ["part", "filter_order", "step"]
