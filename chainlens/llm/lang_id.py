"""Operator 4: language identification with bit-sliced Bloom filters.

Training takes the character trigrams of a bounded sample of labelled texts
and keeps, for each language, those that are about as frequent there as in
the language where they are most frequent.  The kept trigrams go into one
Bloom filter a language, all with the same hash positions, stored sliced:
position -> bit mask of the languages that set it.  The AND of a trigram's
masks is thus the set of all languages that contain it.

A text's language is the one whose bit is set for most of its trigrams, after
taking off the hits that the filter gives by chance (fill share to the power
of the number of hashes).

The filter has a fixed number of positions for the bounded sample, so it is
safe to broadcast.  Prediction is one pass of vectorised Arrow batches
without a shuffle.

Defined results: null text, or text without a letter, is ``und`` with score
0.  Rows with null id or null language are not learned from.  Ties go to the
first language in alphabetical order.  Without any labelled row everything is
``und``.  Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlens.llm.common import fresh, sliced

UNKNOWN = "und"
SAMPLE_PER_LANGUAGE = 3000   # labelled documents a language at most (on average)
MIN_COUNT = 3                # sightings below which a trigram is not learned
LEAST_SHARE = 0.3            # of the trigram's frequency where it is most frequent
HASHES = 3
POSITIONS_PER_GRAM = 16
CHUNK = 1 << 18              # characters handled at once
MIN_SCORE = 0.2              # below it the pipeline stage rejects a text

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def letter_table() -> np.ndarray:
    """Code point -> is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(points: np.ndarray, owner: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    is_letter = letters[points]
    c = np.where(is_letter, points, 32).astype(np.uint64)
    mid = is_letter[1:-1]
    g = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    return owner[1:-1][mid], g[mid]


def trigrams(texts: list[str], letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of (text number, trigram) over lower-cased letters.  Every other
    character is a blank, and a trigram's middle is always a letter, so none
    spans two words or two texts."""
    held, owners, size = [], [], 0
    for k, text in enumerate(texts):
        p = _points(" " + text.lower() + " ")
        if len(p) > CHUNK:  # slices share two characters, so no trigram is lost or met twice
            for start in range(0, len(p) - 2, CHUNK):
                part = p[start:start + CHUNK + 2]
                yield _grams(part, np.full(len(part), k, dtype=np.int64), letters)
            continue
        held.append(p)
        owners.append(np.full(len(p), k, dtype=np.int64))
        size += len(p)
        if size >= CHUNK:
            yield _grams(np.concatenate(held), np.concatenate(owners), letters)
            held, owners, size = [], [], 0
    if held:
        yield _grams(np.concatenate(held), np.concatenate(owners), letters)


def _mixed(g: np.ndarray, k: int) -> np.ndarray:
    h = (g + np.uint64(_ODD[k])) * np.uint64(_ODD[(k + 1) % 4])
    h ^= h >> np.uint64(29)
    h *= np.uint64(_ODD[(k + 2) % 4])
    return h >> np.uint64(32)


class SlicedBloom:
    """Position -> languages that set it, as words of 64 languages."""

    def __init__(self, languages: list[str], positions: int = 64, bits: np.ndarray | None = None):
        self.languages = languages
        self.bits = (np.zeros((max(1, (len(languages) + 63) // 64), positions), dtype=np.uint64)
                     if bits is None else bits)
        self.positions = self.bits.shape[1]

    def add(self, language: int, grams: np.ndarray) -> None:
        word, bit = divmod(language, 64)
        for k in range(HASHES):
            self.bits[word, _mixed(grams, k) & np.uint64(self.positions - 1)] |= np.uint64(1 << bit)

    def masks(self, grams: np.ndarray) -> list[np.ndarray]:
        """Per word of 64 languages: the languages that contain each trigram."""
        at = [_mixed(grams, k) & np.uint64(self.positions - 1) for k in range(HASHES)]
        out = []
        for word in self.bits:
            m = word[at[0]]
            for a in at[1:]:
                m = m & word[a]
            out.append(m)
        return out

    def chance(self) -> np.ndarray:
        """Share of strange trigrams that each language's slice lets through."""
        return np.array([float(np.mean((self.bits[i // 64] >> np.uint64(i % 64)) & np.uint64(1))) ** HASHES
                         for i in range(len(self.languages))])

    def shares(self, texts: list[str], letters: np.ndarray) -> np.ndarray:
        """Per text and language: share of its trigrams in the language, corrected for chance."""
        hits = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts))
        for owner, g in trigrams(texts, letters):
            if not len(g):
                continue
            total += np.bincount(owner, minlength=len(texts))
            masks = self.masks(g)
            for i in range(len(self.languages)):
                has = ((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(bool)
                hits[:, i] += np.bincount(owner[has], minlength=len(texts))
        p = self.chance()
        n = np.maximum(total, 1)[:, None]
        return np.clip((hits / n - p) / np.maximum(1 - p, 1e-9), 0, 1)


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = SAMPLE_PER_LANGUAGE) -> SlicedBloom:
    """Learn from labelled rows.  ``per_language`` bounds the sample: rows are
    drawn by a hash of their id at a rate set from the language's row count."""
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col)).count().collect()}  # one row a language
    languages = sorted(counts)
    if not languages:
        return SlicedBloom([])
    rates = F.create_map(*[F.lit(x) for k in languages for x in (k, per_language / counts[k])])
    drawn = (F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1_000_000)) / 1_000_000) < rates[F.col(lang_col)]
    sample = rows.where(drawn).select(F.array_position(F.array(*[F.lit(x) for x in languages]), F.col(lang_col))
                                      .cast("int").alias("k"), F.col(text_col).alias("t"))

    table = rows.sparkSession.sparkContext.broadcast(letter_table())

    def count(batches):
        letters = table.value
        for b in sliced(batches):
            ks = np.array(b.column(0).to_pylist(), dtype=np.int64)
            texts = b.column(1).to_pylist()
            for k in np.unique(ks):
                own = [t for t, i in zip(texts, ks) if i == k]
                parts = [np.unique(g, return_counts=True) for _, g in trigrams(own, letters)]
                if not parts:
                    continue
                g = np.concatenate([p[0] for p in parts]).astype(np.int64)
                n = np.concatenate([p[1] for p in parts]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k - 1, dtype=np.int32)), pa.array(g),
                                                  pa.array(n)], names=["k", "g", "n"])

    seen = (sample.mapInArrow(count, "k int, g long, n long").groupBy("k", "g").agg(F.sum("n").alias("n")))
    # The sample is bounded, so are its distinct trigrams.
    kept = seen.where(F.col("n") >= MIN_COUNT).toArrow()
    k, g, n = (np.asarray(kept.column(c)) for c in ("k", "g", "n"))
    share = n / np.maximum(np.bincount(k, weights=n, minlength=len(languages)), 1)[k]
    grams, at = np.unique(g, return_inverse=True)
    best = np.zeros(len(grams))
    np.maximum.at(best, at, share)
    keep = share >= LEAST_SHARE * best[at]
    most = int(np.bincount(k[keep], minlength=1).max()) if keep.any() else 1
    bloom = SlicedBloom(languages, 1 << max(6, int(np.ceil(np.log2(most * POSITIONS_PER_GRAM)))))
    for i in range(len(languages)):
        bloom.add(i, g[keep & (k == i)].astype(np.uint64))
    return bloom


def predict(docs: DataFrame, bloom: SlicedBloom, text_col: str = "text", lang_out: str = "lang_pred",
            score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score (share of the text's
    trigrams that the language contains); columns of these names are replaced."""
    docs = docs.drop(lang_out, score_out)
    model = docs.sparkSession.sparkContext.broadcast((bloom.languages, bloom.bits, letter_table()))
    schema = T.StructType(docs.schema.fields + [T.StructField(lang_out, T.StringType()),
                                               T.StructField(score_out, T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches):
        languages, bits, letters = model.value
        bloom = SlicedBloom(languages, bits=bits)
        for b in sliced(batches):
            texts = [t or "" for t in b.column(at).to_pylist()]
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if bloom.languages:
                shares = bloom.shares(texts, letters)
                best = shares.argmax(axis=1)
                for i, t in enumerate(texts):
                    if any(map(str.isalpha, t)):
                        langs[i], scores[i] = bloom.languages[best[i]], float(shares[i, best[i]])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def identified(docs: DataFrame, **names) -> DataFrame:
    """Train on the rows that are not held out, predict for all."""
    bloom = train(docs.where(~is_held_out(F.col("doc_id"))))
    return predict(docs, bloom, **names)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bloom = train(docs.where(~is_held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", "text"), bloom)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without a recognised language go; ``lang`` stays as given."""
    lang, score = fresh(docs, "_lang"), fresh(docs, "_score")
    out = identified(docs, lang_out=lang, score_out=score)
    return out.where((F.col(lang) != UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(*docs.columns)
