import hashlib
import random

import pytest

from chainlens.llm import line_dedup as L
from llm_util import AWKWARD, prose, table

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(rows, min_chars=20, min_docs=3):
    where = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                where.setdefault(key(line), set()).add(L_ID(i))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(where.get(key(x), ())) < min_docs or max(where[key(x)]) == L_ID(i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def L_ID(i):
    return -(1 << 63) if i is None else i


def rows_of(seed=1):
    rng = random.Random(seed)
    common = [f"Shared passage number {k} that many documents hold" for k in range(6)]
    rows = list(AWKWARD)
    for i in range(60):
        lines = prose(rng, lines=3).split("\n")
        for k, c in enumerate(common):
            if i % (k + 2) == 0:
                lines.insert(rng.randrange(len(lines) + 1), rng.choice([c, "  " + c.upper() + "\t"]))
        if i % 20 < 2:
            lines.append("A line that only a pair of documents holds " + str(i // 20))
        if i % 9 == 0:
            lines += [common[0], common[0]]
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}"))
    rows.append((30, rows[-1][1], "en", "s0"))          # one id, another text
    rows.append((1000, "\n".join(["Short", common[1]] * 3000), "en", "s9"))  # very long
    return rows


def result(df):
    from pyspark.sql import functions as F
    out = L.dedup_lines(df)
    return sorted([tuple(r) for r in out.select("_doc.doc_id", "_n_lines", "_n_dropped",
                                               F.sha2("_kept_text", 256)).collect()], key=str)


def test_equals_brute_force(spark):
    rows = rows_of()
    assert result(table(spark, rows)) == brute(rows)


@pytest.mark.parametrize("batches,fanout,min_docs", [(1, 2, 3), (6, 2, 2), (5, 3, 4)])
def test_any_batches_levels_and_thresholds(spark, batches, fanout, min_docs):
    rows = rows_of(2)
    out = L.dedup_lines(table(spark, rows), batches=batches, fanout=fanout, min_docs=min_docs)
    got = sorted(((r[0], r[1]) for r in out.select("_doc.doc_id", "_n_dropped").collect()), key=str)
    assert got == sorted(((r[0], r[2]) for r in brute(rows, min_docs=min_docs)), key=str)


def test_empty_table_and_stage_columns(spark):
    empty = table(spark, rows_of()).where("false")
    assert result(empty) == []
    docs = table(spark, rows_of())
    out = L.stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("n_chars <> length(text)").count() == 0
