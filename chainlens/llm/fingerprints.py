"""Operator 7: document fingerprints by consistent weighted sampling.

A text is a bag of weighted terms (word pairs, weight = number of uses).  For
each of ``SAMPLES`` samples and each term, two Gamma(2, 1) variables r, c and
a uniform b are derived from a hash of (term, sample).  With weight w::

    t = floor(ln w / r + b),   y = exp(r (t - b)),   a = c / (y exp(r))

and the sample is the (term, t) with the least a.  Two texts agree on a sample
with a probability equal to their generalised Jaccard similarity (sum of
least weights over sum of greatest weights), so the share of equal places of
two fingerprints estimates it.

Terms are 64-bit hashes.  The variables come from three Exp(1) values X, Y and Z
of (term, sample)::

    c = X + Y,   r = D + Z,   b = Z / r   with D = ln(c / X)

X / c is uniform and independent of c, so D is Exp(1) too; c and r are then
Gamma(2, 1) and b is uniform, all independent.  With t = 0, which is every
term of weight 1, a = c exp(-D) = X: the least a of these terms is that of the
least hash, without a logarithm.  Terms of other weights are computed as above.

A text's edited form takes the place of its tail with the head of the next
document.  To meet the next document without a global sort, ids are cut into
ranges at quantiles; each range is sorted in one task, and the first
document of the next range is added to it as a guard row.

Defined results: null text is empty; empty texts share one fingerprint, which
agrees with no other's.  Null ids come first, equal ids in order of their
text's hash.  The last document is followed by the first, also by itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.llm.common import doc_key, quantile_cuts, range_number

SAMPLES = 64
BUCKETS = 1 << 16   # range of the plain numbers that stand for terms in tests
CHUNK = 512         # terms hashed at once
SEED = 0x5EED
RANGE_DOCS = 4000   # documents a range
MAX_RANGES = 10_000 # then ranges grow
EMPTY = 0xFFFF


def _mixed(x: np.ndarray) -> np.ndarray:
    """One-to-one hash of 64-bit numbers, in place."""
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def sample_table() -> np.ndarray:
    """The keys of the samples (columns) for X, Y and Z (rows)."""
    return _mixed(np.arange(SEED, SEED + 3 * SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(3, SAMPLES)


KEYS = sample_table()


def hashes(term: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Hash of each term (rows) and key (columns)."""
    return _mixed(term.astype(np.uint64)[:, None] ^ keys)


def _exponential(h: np.ndarray) -> np.ndarray:
    """Exp(1) value of a hash, growing with it."""
    return -np.log1p(-((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53)


def _packed(h: np.ndarray, a: np.ndarray, t: np.ndarray) -> np.ndarray:
    """(a, 32 bits of term and t) as sortable 64-bit numbers."""
    bits = a.astype(np.float32).view(np.uint32).astype(np.uint64)  # positive floats sort like their bits
    low = _mixed(h + t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFF)
    return (bits << np.uint64(32)) | low


def packed_samples(term: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(a, term, t) of each term and sample as sortable 64-bit numbers."""
    h = hashes(term, KEYS[0])
    x, y, z = _exponential(h), _exponential(hashes(term, KEYS[1])), _exponential(hashes(term, KEYS[2]))
    c = x + y
    d = np.log(c / x)
    r = d + z
    b = np.minimum(z / r, 1 - 2.0 ** -53)
    t = np.floor(np.log(weight)[:, None] / r + b)
    a = np.where(t == 0, x, c * np.exp(-r * (t - b) - r))
    return _packed(h, a, t)


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights of the word pairs (a lone word is a pair with nothing)."""
    words = text.split()
    if not words:
        return np.zeros(0, dtype=np.uint64), np.zeros(0)
    h = np.array([_word(w) for w in words], dtype=np.uint64)
    if len(h) > 1:
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h, return_counts=True)


def _word(w: str) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))


def _chunks(x: np.ndarray):
    return (x[i:i + CHUNK] for i in range(0, len(x), CHUNK))


def signature(text: str, keys: np.ndarray) -> np.ndarray:
    """One 16-bit code a sample."""
    term, weight = terms(text)
    if not len(term):
        return np.full(SAMPLES, EMPTY, dtype=np.uint16)
    one = weight == 1
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    if one.any():
        h = least
        for part in _chunks(term[one]):
            h = np.minimum(h, hashes(part, keys[0]).min(axis=0))
        least = _packed(h, _exponential(h), np.zeros(SAMPLES))
    for part, w in zip(_chunks(term[~one]), _chunks(weight[~one])):
        least = np.minimum(least, packed_samples(part, w).min(axis=0))
    code = (least & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    return ((code >> np.uint64(40)) % np.uint64(EMPTY)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def followed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_docs: int = RANGE_DOCS) -> DataFrame:
    """Rows (_part, _d, _tie, _id, _text, _own) of each range in order, the
    first of the next range behind them with ``_own`` false."""
    spark = docs.sparkSession
    rows = docs.select(doc_key(F.col(id_col)).alias("_d"), F.col(id_col).cast("long").alias("_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    count = docs.count()
    cuts = quantile_cuts(rows, "_d", min(MAX_RANGES, max(1, count // range_docs)))
    rows = rows.withColumn("_part", range_number(F.col("_d"), cuts))
    firsts = sorted((r[0], r[1]) for r in rows.groupBy("_part").agg(F.min("_d")).collect())  # one row a range
    if not firsts:
        return rows.select("_part", "_d", F.lit(0).cast("long").alias("_tie"), "_id", "_text", F.lit(True).alias("_own"))
    heads = spark.createDataFrame([(d, firsts[k - 1][0]) for k, (_, d) in enumerate(firsts)], "_d long, _before int")
    guards = (rows.join(F.broadcast(heads), "_d")
              .select(F.col("_before").alias("_part"), "_d", F.xxhash64("_text").alias("_tie"), "_id", "_text",
                      F.lit(False).alias("_own")))
    own = rows.select("_part", "_d", F.xxhash64("_text").alias("_tie"), "_id", "_text", F.lit(True).alias("_own"))
    return (own.unionByName(guards).repartition(len(firsts), "_part")
            .sortWithinPartitions("_part", F.desc("_own"), "_d", "_tie", "_text"))


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  range_docs: int = RANGE_DOCS) -> DataFrame:
    """(_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    schema = ("_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def run(batches):
        out: list[tuple] = []
        before = None  # (part, id, text, fingerprint) that waits for its next

        def emit(now, text, mine):
            _, i, own, print_ = now
            cut = len(own) // 4
            edited = own[:len(own) - cut] + text[:cut]
            other = signature(edited, KEYS)
            out.append((i, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                        print_.tobytes().hex(), other.tobytes().hex(), likeness(print_, other), likeness(print_, mine)))

        for b in batches:
            for part, i, text, own in zip(*[c.to_pylist() for c in b.columns]):
                # Only the first guard row of a range is its next document.
                if before is None and not own:
                    continue
                mine = signature(text, KEYS)
                if before is not None and before[0] == part:
                    emit(before, text, mine)
                before = (part, i, text, mine) if own else None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=arrow)
                out.clear()

    arrow = pa.schema([("_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                       ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                       ("near_edited", pa.float64()), ("near_next", pa.float64())])
    rows = followed(docs, id_col, text_col, range_docs)
    return rows.select("_part", "_id", "_text", "_own").mapInArrow(run, schema)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fingerprinted(docs).withColumnRenamed("_id", "doc_id")
