"""Operator 3: near-duplicate groups by banded MinHash and odd sketches.

1. Each text becomes the set of its word shingles, SAMPLES MinHash values of
   it, BANDS band keys of ROWS values each, and an *odd sketch*: every
   (sample, MinHash value) flips one of BITS parity bits.  The population
   count of the XOR of two sketches estimates their similarity
   (``1 + BITS / (4 SAMPLES) * ln(1 - 2 xor / BITS)``) and is never more than
   twice the number of differing samples.
2. Texts with equal sets form a class; all else works on one node a class.
3. Nodes that share a band key are candidates.  A bucket's *pivot* is the
   member whose buckets are largest; each member is paired with the one pivot
   that its sketch is nearest to, so a bucket of any size gives one pair a
   member.  Pairs whose sketches differ too much for the threshold are
   dropped (the limit leaves out a true link with a probability under 1e-6).
4. The others are confirmed on the full sets and joined into components.
5. Buckets whose members are not all in one component yet may hold links
   between members.  Their *strays* (members outside the bucket's largest
   component) are compared with all others through a prefix index: sets are
   ordered by rising frequency, and a pair above the threshold shares a
   shingle in both prefixes at positions that leave enough room.  What passes
   is checked by sketch and by full set like the first pairs.
6. Components over all confirmed links; a document's component is the
   smallest ``doc_id`` that it reaches.

Nothing pairs up all members of a bucket; sets, sketches and labels move by
shuffles on their keys, and one-row-a-key sides with many matches are
broadcast up to a fixed number of rows (``join_by_size``) or left to the
skew-join splitting of adaptive execution.

Defined results: null, empty or blank texts have no shingles and are linked
with nothing.  Each row is judged by its own text, also where rows share an
id; each gets a row.  A null id counts as the smallest, and a component whose
smallest id is null has a null component_id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.llm.common import NO_ID, doc_key, fresh, join_by_size, sliced, written

WORDS = 5
PERCENT = 80
SAMPLES = 128
ROWS, BANDS = 4, 24
BITS = 512
SIGMAS = 5.2
CELLS = 1 << 18        # counters for the order of shingles
CHUNK = 512            # shingles hashed at once
FILTER_BITS = 1 << 23  # of the filter that picks the texts to read again


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles (the whole sequence if it is shorter)."""
    from xxhash import xxh3_64_intdigest
    # Bytes: lower() changes A-Z only, split() parts at \x20 and \x09-\x0D only.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        return np.array([xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    h = np.array([xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    out = h[:len(h) - width + 1].copy()
    for i in range(1, width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - width + 1 + i]
        out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def hash_parameters() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20))
    a = rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def minhash(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), CHUNK):
        np.minimum(least, (s[i:i + CHUNK, None] * a + b).min(axis=0), out=least)
    return least


def band_keys(m: np.ndarray) -> np.ndarray:
    parts = m[:ROWS * BANDS].reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for i in range(ROWS):
        key = (key ^ parts[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def odd_sketch(m: np.ndarray) -> np.ndarray:
    """Parity of the bits that the (sample, value) pairs fall on, as 64-bit words."""
    at = (m + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
    at = (at ^ (at >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    odd = np.bincount((at >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_flipped(percent: int) -> int:
    """XOR bits that a pair at the threshold exceeds with a probability under 1e-6."""
    s = percent / 100
    return 2 * math.ceil(SAMPLES * (1 - s) + SIGMAS * math.sqrt(SAMPLES * s * (1 - s)))


def flipped(x: Column, y: Column) -> Column:
    return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(BITS // 64)), F.lit(0))


def signatures(rows: DataFrame, width: int) -> DataFrame:
    """Per row (_id, _d, _text): set size, set digest, band keys and odd sketch."""
    def run(batches):
        from xxhash import xxh3_128_digest
        a, b = hash_parameters()
        for batch in sliced(batches):
            node, size, bands, odd = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text, width)
                size.append(len(s))
                m = minhash(s, a, b) if len(s) else None
                node.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(m) if len(s) else None)
                odd.append(odd_sketch(m) if len(s) else None)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(node, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                names=["_id", "_d", "n", "node", "bands", "odd"])

    return rows.mapInArrow(run, "_id long, _d long, n long, node binary, bands array<long>, odd array<long>")


def _filter_bits(ids: np.ndarray) -> list[np.ndarray]:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return [h >> np.uint64(64 - FILTER_BITS.bit_length() + 1), (h ^ (h >> np.uint64(23))) & np.uint64(FILTER_BITS - 1)]


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bloom filter of a column of ids: FILTER_BITS bits whatever their number."""
    def run(batches):
        bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
        for b in batches:
            for at in _filter_bits(np.asarray(b.column(0))):
                np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], names=["at", "bits"])

    found = ids.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    bits[np.asarray(found.column(0))] = np.asarray(found.column(1)).view(np.uint64)
    return bits


def shingle_sets(rows: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, n, hashes): the full sets of ``nodes`` (node, rid), packed.

    The texts are read again where they lie; a filter of the ids, of fixed
    size, leaves out nearly all that aren't needed, and the join with the
    nodes the rest."""
    shared = rows.sparkSession.sparkContext.broadcast(id_filter(nodes.select("rid")))

    def run(batches):
        from xxhash import xxh3_128_digest
        bits = shared.value
        for batch in batches:
            hit = np.ones(batch.num_rows, dtype=bool)
            for at in _filter_bits(np.asarray(batch.column(0))):
                hit &= ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
            texts = batch.column(1).filter(pa.array(hit))
            for start in range(0, len(texts), 256):
                sets = [shingles(t, width) for t in texts.slice(start, 256).to_pylist()]
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["node", "n", "hashes"])

    found = rows.select("_d", "_text").mapInArrow(run, "node binary, n long, hashes binary")
    return found.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    def run(batches):
        for batch in sliced(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)],
                                             names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("_x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("_y"))
    return (pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "_x", "_y")
            .mapInArrow(run, "a binary, b binary"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the least rid of each node's component, by spreading the
    least label over links and jumping to the label's own label."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))),
                   "near_links")
    labels = nodes.join(both.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select(
        "node", "rid", F.col("rid").alias("label"))
    labels = written(labels, "near_labels")
    while True:
        low = (both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"))
               .agg(F.min("label").alias("_low")))
        step = labels.join(low, "node").select("node", "rid", "label", F.least("label", "_low").alias("_new"))
        via = step.groupBy(F.col("rid").alias("_at")).agg(F.min("_new").alias("_via"))
        moved = written(step.join(via, F.col("_new") == F.col("_at"), "left").select(
            "node", "rid", F.least("_new", F.coalesce("_via", "_new")).alias("label"),
            (F.least("_new", F.coalesce("_via", "_new")) != F.col("label")).alias("_changed")), "near_labels")
        labels = moved.select("node", "rid", "label")
        if moved.where("_changed").isEmpty():
            return labels.select("node", "label")


def _star_pairs(members: DataFrame, total: int, limit: int) -> DataFrame:
    """(a, b): each member and, of the pivots of its buckets, the nearest by sketch."""
    pivots = members.groupBy("key").agg(
        F.max_by(F.struct("node", "odd"), F.struct("pop", "rid")).alias("_p"), F.count(F.lit(1)).alias("_size"))
    near = join_by_size(members, pivots, ["key"], "_size", total).withColumn("_x", flipped(F.col("odd"), F.col("_p.odd")))
    return (near.where((F.col("node") != F.col("_p.node")) & (F.col("_x") <= limit))
            .groupBy(F.col("node").alias("a")).agg(F.min_by(F.col("_p.node"), F.struct("_x", "_p.node")).alias("b")))


def _unresolved(members: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """(node, label, stray) of the members of buckets that hold several components."""
    m = members.select("key", "node", "rid").join(labels, "node", "left").select(
        "key", "node", F.coalesce("label", "rid").alias("label"))
    open_ = m.groupBy("key").agg(F.count(F.lit(1)).alias("_size"), F.min("label").alias("_a"),
                                 F.max("label").alias("_b")).where(F.col("_a") != F.col("_b")).select("key", "_size")
    m = written(join_by_size(m, open_, ["key"], "_size", total), "near_open")
    largest = (m.groupBy("key", "label").agg(F.count(F.lit(1)).alias("_k"), F.first("_size").alias("_size"))
               .groupBy("key").agg(F.max(F.struct("_k", "label")).alias("_top"), F.first("_size").alias("_all")))
    return (join_by_size(m, largest, ["key"], "_all", total).groupBy("node", "label")
            .agg(F.max(F.col("label") != F.col("_top.label")).alias("stray")))


def _prefix_pairs(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): strays and nodes of other components that share a prefix shingle with enough room behind it."""
    spark = open_.sparkSession
    sets = sets.join(open_, "node").select("node", "label", "stray", "hashes")

    def count(batches):
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                s = np.frombuffer(x.as_buffer(), dtype=np.uint64)
                np.add.at(total, (s & np.uint64(CELLS - 1)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    # CELLS counters whatever the input; any order of the shingles is right,
    # rare ones first keeps the index short.
    cells = sets.select("hashes").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(CELLS, dtype=np.int64)
    frequency[np.asarray(cells.column(0))] = np.asarray(cells.column(1))
    shared = spark.sparkContext.broadcast(frequency)

    def prefixes(batches):
        frequency = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found, at, size, owner = [], [], [], []
                for k, x in enumerate(part.column(3)):
                    s = np.frombuffer(x.as_buffer(), dtype=np.uint64)
                    n = len(s)
                    long = n - -(-percent * n // 100) + 1
                    order = np.lexsort((s, frequency[s & np.uint64(CELLS - 1)]))[:long]
                    found.append(s[order].view(np.int64))
                    at.append(np.arange(len(order), dtype=np.int32))
                    size.append(np.full(len(order), n, dtype=np.int32))
                    owner.append(np.full(len(order), k, dtype=np.int64))
                k = pa.array(np.concatenate(owner)) if owner else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(found)), pa.array(np.concatenate(at)), pa.array(np.concatenate(size)),
                    part.column(0).take(k), part.column(1).take(k), part.column(2).take(k)],
                    names=["s", "at", "n", "node", "label", "stray"])

    rows = written(sets.mapInArrow(prefixes, "s long, at int, n int, node binary, label long, stray boolean"),
                   "near_prefixes")
    x, y = rows.where("stray").alias("x"), rows.alias("y")
    room = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    on = ((F.col("x.s") == F.col("y.s")) & (F.col("x.label") != F.col("y.label"))
          & ((100 + percent) * room >= percent * (F.col("x.n") + F.col("y.n"))))
    return x.join(y, on).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS,
           percent: int = PERCENT) -> DataFrame:
    """(_id, n, component, kept) per row of ``docs``."""
    limit = most_flipped(percent)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), doc_key(F.col(id_col)).alias("_d"),
                       F.col(text_col).alias("_text"))
    sig = written(signatures(rows, width), "near_signatures")
    classes = written(sig.where("n > 0").groupBy("node").agg(
        F.min("_d").alias("rid"), F.count(F.lit(1)).alias("size"), F.first("bands").alias("bands"),
        F.first("odd").alias("odd")), "near_classes")

    keys = classes.select("node", F.explode("bands").alias("key"))
    total = classes.count() * BANDS
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    shared = written(join_by_size(keys, sizes, ["key"], "_size", total), "near_buckets")
    pop = shared.groupBy("node").agg(F.sum("_size").alias("pop"))
    members = written(shared.select("key", "node").join(classes.select("node", "rid", "odd").join(pop, "node"), "node"),
                      "near_members")
    nodes = written(members.groupBy("node").agg(F.min("rid").alias("rid"), F.first("odd").alias("odd")), "near_nodes")
    sets = written(shingle_sets(rows, nodes, width), "near_sets")

    first = written(confirmed(_star_pairs(members, total, limit), sets, percent), "near_first")
    labels = components(nodes, first)
    open_ = written(_unresolved(members, labels, total), "near_unresolved")
    pairs = _prefix_pairs(open_, sets, percent)
    sketch = nodes.select("node", "odd")
    pairs = (pairs.join(sketch.select(F.col("node").alias("a"), F.col("odd").alias("_o")), "a")
             .join(sketch.select(F.col("node").alias("b"), F.col("odd").alias("_p")), "b")
             .where(flipped(F.col("_o"), F.col("_p")) <= limit).select("a", "b"))
    second = written(confirmed(pairs, sets, percent), "near_second")
    if not second.isEmpty():
        labels = components(nodes, first.unionByName(second))

    found = classes.select("node", "rid", "size").join(labels, "node", "left").select(
        "node", "size", F.coalesce("label", "rid").alias("_label"))
    linked = join_by_size(sig.where("n > 0").select("_id", "_d", "n", "node"), found, ["node"], "size", sig.count())
    out = linked.select("_id", "_d", "n", "_label").unionByName(
        sig.where("n = 0").select("_id", "_d", "n", F.col("_d").alias("_label")))
    return out.select("_id", "n", F.when(F.col("_label") != NO_ID, F.col("_label")).alias("component"),
                      (F.col("_label") == F.col("_d")).alias("kept"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return groups(docs, width=3, percent=85).select(
        F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group stays, its smallest id.

    Rows that share an id, or have none, are told apart by a number of their
    own, given once and written: of a group's rows with the smallest id (of
    its rows without an id, if it has no other) the first number stays."""
    ids = docs.groupBy("doc_id").count().agg(F.max("count").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    if (ids["n"] or 0) <= 1 and not ids["none"]:
        found = groups(docs).where("kept").select(doc_key(F.col("_id")).alias("_keep"))
        return docs.join(found, doc_key(docs["doc_id"]) == found["_keep"], "left_semi")
    number = fresh(docs, "_number")
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "near_rows")
    found = groups(rows, id_col=number).select(F.col("_id").alias("_n"), "component")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_n"))
    keep = (rows.select(F.col(number).alias("_n"), "doc_id").join(found, "_n").groupBy("component")
            .agg(F.min(order)["_n"].alias("_keep")))
    return rows.join(keep, rows[number] == keep["_keep"], "left_semi").drop(number)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id
      GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS hit FROM w UNION SELECT r.doc_id, g.b FROM r JOIN g ON g.a = r.hit),
m AS (SELECT doc_id, min(hit) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
