"""Corpus preparation: five stages, each of which applies one text operator to
all the documents that the stage before kept.

language    texts without a recognised language go
lines       lines that repeat across documents stay in one of them
near        one document of each group of near-duplicates stays
mixture     documents are repeated or dropped by the rates that meet the target mix
tokens      byte-level BPE ids of what is left, with digests
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chainlens.llm import bpe, lang_id, line_dedup, mixing, near_dedup
from chainlens.session import scratch_path

STAGES = [
    ("language", lang_id.stage),
    ("lines", line_dedup.stage),
    ("near", near_dedup.stage),
    ("mixture", mixing.stage),
    ("tokens", bpe.stage),
]

# The classifier, the rates and the merges can't be put in SQL; tests/llm compares
# every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written to the shared scratch folder and read
    again, so a lost executor never sends the work back to the start."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
