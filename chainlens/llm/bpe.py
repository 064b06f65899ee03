"""Operator 9: byte-level BPE over a global shuffle of distinct words.

Encoding has three steps, none of which repeats the merges of a word:

1. *Explode.*  Each text is split into pre-tokens with positions.  A block of
   documents keeps each of its distinct pre-tokens once, dealt by hash to
   buckets, and each document as the sequence of its pre-tokens' numbers.
2. *Encode each distinct word once.*  The word lists are shuffled by bucket,
   so all uses of a word come to one place, where its merges are run once;
   the ids go back to every block that holds the word.
3. *Reassemble.*  A block's ids and documents meet again by block; the ids
   are put at their positions.

Decoding looks the ids up in the token-byte table (one row an id of the
vocabulary) and joins the bytes in order.

Lists move as rows of packed arrays (one row a block and bucket), positions
as numbers ranked by use in the block.  A frequent word is thus one entry a
block and not one a use.  Blocks are cut by characters, so their size does not
grow with the data; a longer text is a block of its own.

The words and the documents' sequences are two passes over the same table:
writing them to disk between would cost more than splitting again.  The table
must give the same rows in the same order each time, as files do; a block
whose words don't match its documents is an error, not a wrong result.

Defined results: null text has no ids.  Rows are reassembled one by one, so
repeated rows and null ids are kept apart.  Extra columns are not read.  An
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlens.llm.common import shuffle_width

RANKS = "byte_bpe_50k.tiktoken"
BLOCK_CHARS = 4 << 20
KNOWN_WORDS = 1_000_000   # distinct words a task remembers
ORDER_ERROR = "the documents were not read in the same order twice; write them to a table first"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: join the adjacent pair of lowest rank until none is known."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i:i + 1] for i in range(len(word))]
    if len(parts) > 200:
        return _merged_long(word, ranks)
    pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
    while True:
        best, at = None, -1
        for i, r in enumerate(pairs):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1])


def _merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap and linked neighbours, for very long pre-tokens."""
    import heapq
    n = len(word)
    part: list[bytes | None] = [word[i:i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, size = heapq.heappop(heap)
        j = after[i] if part[i] is not None else n
        if part[i] is None or j >= n or ranks.get(part[i] + part[j]) != r or len(part[i]) + len(part[j]) != size:
            continue
        part[i], part[j] = part[i] + part[j], None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (x := ranks.get(part[i] + part[after[i]])) is not None:
                heapq.heappush(heap, (x, i, len(part[i]) + len(part[after[i]])))
        if (k := before[i]) >= 0 and (x := ranks.get(part[k] + part[i])) is not None:
            heapq.heappush(heap, (x, k, len(part[k]) + len(part[i])))
    return [ranks[p] for p in part if p is not None]


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers by byte planes, deflated: the high planes are nearly free."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _blocks(batches, block_chars: int):
    """(block, [(id, text)]) in the order of the input."""
    from pyspark import TaskContext
    block, held, chars = TaskContext.get().partitionId() << 32, [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            t = t or ""
            if held and chars + len(t) > block_chars:
                yield block, held
                block, held, chars = block + 1, [], 0
            held.append((i, t))
            chars += len(t)
    if held:
        yield block, held


def _numbered(held, find) -> tuple[list[int], np.ndarray, pa.Array]:
    """Pre-tokens a text, the number of each pre-token, and the words by number
    (most used first)."""
    sizes, words = [], []
    for _, t in held:
        w = find(t)
        sizes.append(len(w))
        words.extend(w)
    coded = pa.array(words, pa.string()).dictionary_encode()
    if not words:
        return sizes, np.zeros(0, dtype=np.int64), pa.array([], pa.binary())
    at = np.asarray(coded.indices)
    order = np.argsort(-np.bincount(at), kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return sizes, rank[at], coded.dictionary.take(pa.array(order)).cast(pa.binary())


def _finder():
    import regex
    return regex.compile(public_tokenizers.PATTERN).findall


def _buckets(words: pa.Array, buckets: int) -> np.ndarray:
    return np.array([zlib.crc32(w) % buckets for w in words.to_pylist()], dtype=np.int64)


def distinct_words(rows: DataFrame, block_chars: int, buckets: int) -> DataFrame:
    """(block, bucket, sizes, words): the distinct pre-tokens of each block of
    ``rows`` (_id, _text), by bucket and in the order of their numbers."""
    def run(batches):
        find = _finder()
        for block, held in _blocks(batches, block_chars):
            _, _, words = _numbered(held, find)
            at = _buckets(words, buckets)
            order = np.argsort(at, kind="stable")
            used, starts = np.unique(at[order], return_index=True)
            sizes, lists = [], []
            for mine in np.split(order, starts[1:]) if len(used) else []:
                w = words.take(pa.array(mine)).to_pylist()
                sizes.append(_packed(np.array([len(x) for x in w])))
                lists.append(zlib.compress(b"".join(w), 1))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(used), block)), pa.array(used.astype(np.int32)), pa.array(sizes, pa.binary()),
                pa.array(lists, pa.binary())], names=["block", "bucket", "sizes", "words"])

    return rows.mapInArrow(run, "block long, bucket int, sizes binary, words binary")


def sequences(rows: DataFrame, block_chars: int, buckets: int) -> DataFrame:
    """(block, _id, size, numbers): each document's pre-tokens by their numbers
    in the block.  A row of size -1 has the bucket of each number instead."""
    def run(batches):
        find = _finder()
        for block, held in _blocks(batches, block_chars):
            sizes, at, words = _numbered(held, find)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(held) + 1, block)), pa.array([None] + [i for i, _ in held], pa.int64()),
                pa.array([-1] + sizes, pa.int32()),
                pa.array([_packed(_buckets(words, buckets))] + [_packed(at[e - n:e]) for n, e in zip(sizes, ends)],
                         pa.binary())], names=["block", "_id", "size", "numbers"])

    return rows.mapInArrow(run, "block long, _id long, size int, numbers binary")


def encode_words(words: DataFrame, ranks_path: str, buckets: int) -> DataFrame:
    """(block, bucket, counts, ids) for (block, bucket, sizes, words): a bucket's
    lists come to one task, one by one, and each distinct word is encoded there once."""
    def run(batches):
        ranks = load_ranks(ranks_path)
        known: dict[bytes, bytes] = {}
        for b in batches:
            counts, ids = [], []
            for sizes, data in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                ends = np.cumsum(_unpacked(sizes)).tolist()
                data = zlib.decompress(data)
                if len(known) > KNOWN_WORDS:  # bounds the memory; at worst a word is encoded again
                    known = {}
                out = []
                for start, end in zip([0] + ends, ends):
                    w = data[start:end]
                    if (x := known.get(w)) is None:
                        x = known[w] = np.array(merged(w, ranks), dtype="<u4").tobytes()
                    out.append(x)
                counts.append(_packed(np.array([len(x) // 4 for x in out])))
                ids.append(_packed(np.frombuffer(b"".join(out), dtype="<u4")))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())],
                names=["block", "bucket", "counts", "ids"])

    return words.repartition(buckets, "bucket").mapInArrow(run, "block long, bucket int, counts binary, ids binary")


def _reassemble(texts: pa.Table, words: pa.Table) -> pa.Table:
    size = texts.column("size").to_pylist()
    numbers = texts.column("numbers").to_pylist()
    ids = texts.column("_id").cast(pa.int64())
    bucket = _unpacked(numbers[size.index(-1)]) if -1 in size else np.zeros(0, dtype=np.int64)
    n = np.zeros(len(bucket), dtype=np.int64)
    starts = np.zeros(len(bucket), dtype=np.int64)
    flat, before, met = [], 0, 0
    for k, counts, part in zip(*[words.column(c).to_pylist() for c in ("bucket", "counts", "ids")]):
        mine, counts = np.flatnonzero(bucket == k), _unpacked(counts)
        if len(mine) != len(counts):
            raise ValueError(ORDER_ERROR)
        n[mine], starts[mine] = counts, before + np.cumsum(counts) - counts
        flat.append(_unpacked(part))
        before, met = before + len(flat[-1]), met + len(mine)
    if met != len(bucket):
        raise ValueError(ORDER_ERROR)
    flat = np.concatenate(flat).astype("<u4") if flat else np.zeros(0, dtype="<u4")
    out, keep = [], []
    for k, (s, data) in enumerate(zip(size, numbers)):
        if s < 0:
            continue
        at = _unpacked(data)
        ends = np.cumsum(n[at])
        # The pre-token at each position takes flat[its start : its start + n].
        offset = np.repeat(starts[at] - (ends - n[at]), n[at]) + np.arange(int(ends[-1]) if s else 0)
        out.append(flat[offset].tobytes())
        keep.append(k)
    return pa.table({"_id": ids.take(pa.array(keep, pa.int64())), "ids": pa.array(out, pa.binary())})


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None,
           block_chars: int = BLOCK_CHARS, decoded: bool = False) -> DataFrame:
    """(_id, ids) of every row: ids as little-endian uint32; with ``decoded``
    also their bytes again, looked up by the task that put the ids together."""
    ranks_path = ranks_path or public_tokenizers.path(RANKS)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    buckets = shuffle_width(docs.sparkSession)
    back = encode_words(distinct_words(rows, block_chars, buckets), ranks_path, buckets)
    held: list[TokenBytes] = []

    def reassemble(texts: pa.Table, words: pa.Table) -> pa.Table:
        out = _reassemble(texts, words)
        if decoded:
            if not held:
                held.append(TokenBytes(load_ranks(ranks_path)))
            out = out.append_column("decoded", pa.array([held[0].join(np.frombuffer(x, dtype="<u4"))
                                                         for x in out.column("ids").to_pylist()], pa.binary()))
        return out

    return (sequences(rows, block_chars, buckets).groupBy("block").cogroup(back.groupBy("block"))
            .applyInArrow(reassemble, "_id long, ids binary" + ", decoded binary" * decoded))


class TokenBytes:
    """The token-byte table: id -> bytes, laid out flat for lookups of whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        table = [b""] * size
        for token, i in ranks.items():
            table[i] = token
        self.length = np.array([len(t) for t in table], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.flat = np.frombuffer(b"".join(table), dtype=np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.start[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ids) else 0)
        return self.flat[at].tobytes()


def decode(rows: DataFrame, ids_col: str = "ids", out_col: str = "decoded", ranks_path: str | None = None) -> DataFrame:
    """``rows`` with the bytes of their ids added as ``out_col``."""
    ranks_path = ranks_path or public_tokenizers.path(RANKS)
    schema = T.StructType(rows.schema.fields + [T.StructField(out_col, T.BinaryType())])
    at = rows.columns.index(ids_col)

    def run(batches):
        table = TokenBytes(load_ranks(ranks_path))
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                out = [None if x is None else table.join(np.frombuffer(x, dtype="<u4"))
                       for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())],
                                                 names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    out = encode(docs, decoded=True)
    return out.select(F.col("_id").alias("doc_id"), (F.length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: per document the ids with their digest and that of the decoded text."""
    return digests(docs)
