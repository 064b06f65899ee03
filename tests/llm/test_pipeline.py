import os


import corpus_pipeline as C
from chainlens.session import scratch_path
import test_line_dedup
import test_near_dedup

SF = "/root/testdata/sf0.001"


def test_stages_over_the_test_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        path = scratch_path(spark, name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen.append((name, before, docs))
        if name != "tokens":
            assert docs.columns == columns
    rows = {name: ([tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()]) for name, a, b in seen}
    # lines: texts equal the brute-force ones
    a, b = rows["lines"]
    want = {r[0]: r[3] for r in test_line_dedup.brute([x[:4] for x in a])}
    import hashlib
    assert {r[0]: hashlib.sha256(r[1].encode()).hexdigest() for r in b} == want
    # near: the smallest id of each brute-force group
    a, b = rows["near"]
    assert sorted(r[0] for r in b) == sorted(r[0] for r in test_near_dedup.brute([x[:4] for x in a], 5, 80) if r[3])
    # tokens: decoded bytes are the texts
    a, b = rows["tokens"]
    assert sorted(hashlib.sha256(r[1].encode()).hexdigest() for r in a) == sorted(r[3] for r in b)
    assert sorted(tuple(r) for r in C.run(spark, SF).collect()) == sorted(b)


def test_queries_are_registered():
    import __spark_entry__ as E
    names = E.queries()
    assert {f"op{n}_" for n in range(1, 14)} <= {k[:k.index("_") + 1] for k in names if k.startswith("op")}
    assert "pipeline" in names and len(C.STAGES) == 5
    assert set(E.oracle_sql()) <= set(names)


def test_rest_works_without_the_text_operators(tmp_path):
    """A copy without llm folders and corpus_pipeline.py still imports and lists the other queries."""
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.abspath(C.__file__))
    shutil.copytree(f"{root}/chainlens", tmp_path / "chainlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and "
                           "'pipeline' not in q and set(e.oracle_sql()) <= set(q)"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
