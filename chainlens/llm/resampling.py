"""Operator 12: target-distribution importance resampling.

Documents are drawn with probability proportional to how much likelier their
words are under a target corpus than under the corpus itself.  Features are
hashed runs of one to ORDERS words; a bucket's gain is the log ratio of its
smoothed shares in both corpora; a document's weight is the sum of its
features' gains, and weight plus Gumbel noise ranks the documents
(sampling without replacement).

*Features by batch concatenation.*  The texts of a batch are joined with a
separator that no word holds, one regular-expression pass over the joined
bytes finds all words, and ``searchsorted`` in the documents' offsets gives
each word its document; runs whose first and last word lie in different
documents are masked.  The checksum of a run comes from those of its words:
the checksum of ``a + b`` is that of ``a``, moved on by ``len(b)`` zero
bytes, combined with that of ``b``.  Moving on is linear, so it is four table
look-ups for all runs at once.  Words are taken BLOCK at a time, with the
last words of a block carried to the next, so that memory does not grow with
a text's length.

*Passes.*  One pass counts features (a task sums its own counts and emits one
row a bucket), a second one weighs the documents; the vector of gains has one
number a bucket.  Nothing is stored per feature.

*Ranks.*  Only the rows near the top are sorted: cuts at high quantiles deal
them into ranges, exact counts of the ranges give each its first rank, and
rows are numbered within their range.  Rows below the last rank wanted are
never sorted.

Defined results: null, empty or blank text has no features and weight 0.
Null ids are hashed like the empty string and come after all others in ties.
Repeated rows each get a row and are drawn one by one.  An empty target gives
gains that only depend on the corpus; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlens.llm.common import range_number, sliced, table, written

ORDERS = 3
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = "42"
SEPARATOR = b"\x00"
# Bytes of words once A-Z are lower-cased: digits, a-z and every byte of a character beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BLOCK = 1 << 17          # words handled at once
LONG = 64                # bytes from which a word's checksum is taken on its own
RANGE_ROWS = 500_000     # rows that one task sorts, about
MAX_CUTS = 10_000


class Checksums:
    """CRC-32 of many byte strings and of their concatenations."""

    def __init__(self):
        t = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
        self.step = t
        # moved[n][j][v]: the value v << 8j moved on by n zero bytes.
        moved = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])]
        for _ in range(LONG):
            moved.append(t[moved[-1] & 255] ^ (moved[-1] >> np.uint32(8)))
        self.moved = np.stack(moved).reshape(-1)

    def words(self, data: bytes, at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Checksum of each ``data[start:end]``; ``at`` is ``data`` as an array."""
        sizes = ends - starts
        order = np.argsort(-np.minimum(sizes, LONG + 1), kind="stable")
        by_size = sizes[order]
        n_long = int(np.searchsorted(-by_size, -LONG, side="left"))
        first, sizes_short = starts[order][n_long:], by_size[n_long:]
        crc = np.full(len(first), 0xFFFFFFFF, dtype=np.uint32)
        live = np.searchsorted(-sizes_short, -np.arange(int(sizes_short[0]) if len(first) else 0), side="left")
        for k, n in enumerate(live):
            crc[:n] = self.step[(crc[:n] ^ at[first[:n] + k]) & 255] ^ (crc[:n] >> np.uint32(8))
        out = np.empty(len(starts), dtype=np.uint32)
        out[order[n_long:]] = ~crc
        for i in order[:n_long]:
            out[i] = zlib.crc32(data[starts[i]:ends[i]])
        return out

    def joined(self, left: np.ndarray, right: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Checksums of ``left + b" " + right`` from those of both; ``right`` is ``data[start:end]``."""
        blank = ~(self.step[(~left ^ np.uint32(32)) & 255] ^ (~left >> np.uint32(8)))
        sizes = ends - starts
        base = np.minimum(sizes, LONG) * 1024
        out = right.copy()
        for j in range(4):
            out ^= self.moved[base + j * 256 + ((blank >> np.uint32(8 * j)) & 255)]
        for i in np.flatnonzero(sizes > LONG):
            out[i] = zlib.crc32(data[starts[i]:ends[i]], int(blank[i]))
        return out


def features(texts: list[bytes], sums: Checksums, orders: int = ORDERS, block: int = BLOCK,
             ) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(text numbers, words in a run, checksums) of all runs of 1 to ``orders`` words, in blocks."""
    data = SEPARATOR.join(texts).lower()
    offsets = np.cumsum([0] + [len(t) + len(SEPARATOR) for t in texts[:-1]])
    at = np.frombuffer(data, dtype=np.uint8)
    found = WORD.finditer(data)
    held = np.empty((0, 2), dtype=np.int64)  # the words before the block that its runs may begin with
    while True:
        spans = np.fromiter(itertools.chain.from_iterable(map(re.Match.span, itertools.islice(found, block))), np.int64)
        if not len(spans):
            return
        spans = np.concatenate([held, spans.reshape(-1, 2)])
        starts, ends = spans[:, 0].copy(), spans[:, 1].copy()
        doc = np.searchsorted(offsets, starts, side="right") - 1
        crc = self_crc = sums.words(data, at, starts, ends)
        for k in range(orders):  # crc: of the k + 1 words that end at each position from k on
            if k:
                crc = sums.joined(crc[:-1], self_crc[k:], data, starts[k:], ends[k:])
            own = max(len(held) - k, 0)  # runs that end in the words held were met before
            whole = doc[k:] == doc[:len(doc) - k]
            yield doc[k:][own:][whole[own:]], k + 1, crc[own:][whole[own:]]
            if len(crc) < 2:
                break
        held = spans[len(spans) - min(orders - 1, len(spans)):]


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def feature_counts(texts: DataFrame, buckets: int = BUCKETS, orders: int = ORDERS) -> np.ndarray:
    """Features in each bucket, over the whole of the only column of ``texts``."""
    def count(batches):
        sums, n = Checksums(), np.zeros(buckets, dtype=np.int64)
        for b in sliced(batches):
            for _, _, crc in features(_texts(b.column(0)), sums, orders):
                n += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=["b", "n"])

    rows = texts.mapInArrow(count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[np.asarray(rows.column("b"))] = np.asarray(rows.column("n"))
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 * log ratio of the smoothed shares)."""
    b = len(source)
    up = (target + 1.0) * (float(source.sum()) + b)
    down = (source + 1.0) * (float(target.sum()) + b)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
            orders: int = ORDERS) -> DataFrame:
    """(_id, _n_words, _n_features, _weight) per row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain, sums = model.value, Checksums()
        for b in sliced(batches):
            texts = _texts(b.column(1))
            n_words, n, w = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
            for doc, k, crc in features(texts, sums, orders):
                met = np.bincount(doc, minlength=len(texts))
                n += met
                n_words += met if k == 1 else 0
                # Sums of integers below 2^53 are exact in doubles.
                w += np.bincount(doc, gain[crc % np.uint32(len(gain))], minlength=len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words), pa.array(n), pa.array(w)],
                                             names=["_id", "_n_words", "_n_features", "_weight"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string")).mapInArrow(
        run, "_id long, _n_words long, _n_features long, _weight long")


def noise(id_col: Column, seed: str = SEED) -> Column:
    """floor(1000 * Gumbel noise), from a hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(rows: DataFrame, wanted: int, eligible: Column, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` (a written table) with _rank: 1 .. ``wanted`` by falling _score among
    the eligible ones, ties to the smaller _id; null for the others."""
    rows = rows.withColumn("_in", eligible)
    total = rows.where("_in").count()
    parts = min(MAX_CUTS, wanted // range_rows + 1)
    # Cuts from a little below the last rank wanted, up to the top; range 0 lies below them all.
    low = max(0.0, 1 - 1.1 * wanted / max(total, 1))
    cuts = sorted(set(rows.where("_in").agg(F.percentile_approx(
        "_score", [low + (1 - low) * i / parts for i in range(parts)], 100_000)).first()[0] or [])) if total else []
    number = range_number(F.col("_score"), cuts)
    sizes = {r[0]: r[1] for r in rows.where("_in").groupBy(number.alias("r")).count().collect()}  # one row a range
    first, ahead = {}, 0
    for r in sorted(sizes, reverse=True):
        if ahead >= wanted:
            break
        first[r] = ahead
        ahead += sizes[r]
    none = F.lit(None).cast("long")
    if not first:
        return rows.withColumn("_rank", none).drop("_in")
    rows = rows.withColumn("_range", number).withColumn("_near", F.col("_in") & (F.col("_range") >= min(first)))
    order = Window.partitionBy("_range").orderBy(F.desc("_score"), F.asc_nulls_last("_id"), "_n_features", "_weight")
    start = F.get(F.array(*[F.lit(first.get(r, 0)).cast("long") for r in range(max(sizes) + 1)]), F.col("_range"))
    place = start + F.row_number().over(order)
    near = rows.where("_near").withColumn("_rank", F.when(place <= wanted, place))
    return near.unionByName(rows.where(~F.col("_near")).withColumn("_rank", none)).drop("_in", "_range", "_near")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              target_text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS,
              buckets: int = BUCKETS, orders: int = ORDERS, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(_id, _n_words, _n_features, _weight, _score, _rank) per row of ``docs``;
    the rows with a rank are the sample that resembles ``target``."""
    gain = gains(feature_counts(target.select(F.col(target_text_col).cast("string")), buckets, orders),
                 feature_counts(docs.select(F.col(text_col).cast("string")), buckets, orders))
    rows = weighed(docs, gain, id_col, text_col, orders)
    rows = written(rows.withColumn("_score", F.col("_weight") + noise(F.col("_id"), seed)), "resample_scores")
    eligible = F.col("_n_words") >= least_words
    return drawn(rows, percent * rows.where(eligible).count() // 100, eligible, range_rows)


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("_id").alias("doc_id"), F.col("_n_features").alias("n_features"), F.col("_weight").alias("weight"),
                      F.col("_score").alias("score"), F.col("_rank").alias("rank"))
