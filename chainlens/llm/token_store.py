"""Operator 8: token ids as range-coded binary blocks (static rANS).

Texts are encoded with a public tokenizer, an end id is added, and the ids
are written in ascending ``doc_id`` order as independent blocks.  All blocks
share one static frequency table (the counts of all ids of the data, scaled
to ``2**SCALE_BITS``).  Inside a block, token ``j`` belongs to lane
``j % LANES``; the lanes are coded side by side as a range asymmetric numeral
system with 64-bit states and 32-bit words, which vectorises over lanes.

A block's payload (little-endian)::

    magic "TOKR", version, lanes, tokens, words, checkpoints        6 x uint32
    checkpoints x (words before it uint32, crc32 of its ids uint32, lane states uint64 each)
    words                                                            uint32 each

Checkpoint ``c`` holds the states with which decoding of ids
``c * STEP * LANES`` onwards can start, so the parts of a block can be decoded
apart, and the checksum of the ids up to the next checkpoint.

Container: three Parquet tables in one folder, written by Spark's own commit
protocol (a lost executor's task is simply run again): ``blocks`` with one
row per block (part, block, counts, document ids and their offsets, payload,
payload checksum), ``frequencies`` (id, count, frequency) and ``parts`` (part,
ids before it).  Documents are
never split over blocks; parts follow quantiles of ``doc_id``, each sorted in
one task, so nothing is sorted or counted in a single place but one number a
part.

Defined results: null text has just the end id.  Null ids sort first, equal
ids by their token ids.  Repeated rows are each written.  An empty table
gives empty files.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlens.llm.common import LOWER, doc_key, quantile_cuts, range_number, written
from chainlens.session import scratch_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
BLOCK_BYTES = 32 << 20       # text that a task encodes at once
WORD_END = "</w>"
TAIL = "!#$%&()*+,-./:;<=>?@[]^_`{|}~\"\\"  # ASCII punctuation but for the apostrophe
HEAD = "^[^" + "".join(f"\\x{ord(c):02X}" for c in TAIL) + "]+"
BLOCK_TOKENS = 1 << 20
PART_TOKENS = 1 << 23
MAX_PARTS = 10_000           # then parts grow
SCALE_BITS = 20
LANES = 2048
STEP = 128                   # steps of all lanes between checkpoints
MAGIC = 0x524B4F54
LOW = np.uint64(1 << 31)
_HEAD = "<6I"
_HEAD_SIZE = struct.calcsize(_HEAD)


class WordEncoder:
    """Ids of texts.  The tokenizer drops white space and never joins across
    it, nor across the end of a run of letters before ASCII punctuation.  So
    the words of a block of texts are cut there, each distinct piece is
    encoded once, and the ids are put together by array lookups.  A run is cut
    off only if the tokenizer's own normaliser and pre-tokenizer keep each of
    its letters whole: some fall apart into a base and a mark, which goes with
    the punctuation."""

    def __init__(self, path: str, dtype: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.dtype = without_cache(load_tokenizer(path)), dtype
        self.bare = self._bare()
        self.apart: dict[str, bool] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True

    def _bare(self):
        """The tokenizer for runs of a to z.  Where its normaliser and
        pre-tokenizer leave these letters as they are, in one piece, and no
        added token is made of letters, they are left out: the same model gets
        the same words."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit
        t = self.tokenizer
        kept = [x for x, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(LOWER))] == [LOWER]
        if not kept or any(x.content.isalpha() for x in t.get_added_tokens_decoder().values()):
            return t
        bare = Tokenizer(t.model)
        bare.pre_tokenizer = WhitespaceSplit()
        return bare

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in a row, and their number for each."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], dtype=self.dtype), np.array([len(x) for x in ids], dtype=np.int64)

    def _runs(self, runs: pa.Array, tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs of letters: as texts of many runs, cut at the ids
        that end a word; if these are not as many, one by one."""
        flat, sizes = [np.zeros(0, dtype=self.dtype)], [np.zeros(0, dtype=np.int64)]
        edges = list(range(0, len(runs), 20_000)) + [len(runs)]
        for i, j in zip(edges, edges[1:]):
            part = runs.slice(i, j - i)
            ids = np.array(tokenizer.encode_batch_fast([_joined(part, " ")], add_special_tokens=False)[0].ids,
                           dtype=self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            size = np.diff(cuts, prepend=0)
            if len(cuts) != len(part):
                ids, size = self._pieces(part.to_pylist())
            flat.append(ids)
            sizes.append(size)
        return np.concatenate(flat), np.concatenate(sizes)

    def _falls_apart(self, letter: str) -> bool:
        """Whether a letter's normal form is no word of its own before punctuation."""
        if letter.isascii():
            return False
        if letter not in self.apart:
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(letter + "!"))
            self.apart[letter] = len(pieces) != 2 or not pieces[1][0].startswith("!")
        return self.apart[letter]

    def encode(self, texts: pa.Array) -> list[bytes]:
        import pyarrow.compute as pc
        split = pc.ascii_split_whitespace(texts)
        edges = np.asarray(split.offsets).astype(np.int64)
        coded = split.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
        edges -= edges[0]
        at, words = np.array(coded.indices), coded.dictionary
        del split, coded
        runs = pc.utf8_rtrim(words, characters=TAIL)
        runs = pc.if_else(pc.utf8_is_alpha(runs), runs, "")
        plain = pc.string_is_ascii(runs)
        odd = [x for x in sorted(set(_joined(runs.filter(pc.invert(plain)), ""))) if self._falls_apart(x)]
        if odd:
            torn = pc.match_substring_regex(runs, "[" + "".join(f"\\x{{{ord(x):X}}}" for x in odd) + "]")
            runs = pc.if_else(torn, "", runs)
        # After a run there is nothing but characters of TAIL.
        rest = pc.if_else(pc.equal(runs, ""), words, pc.replace_substring_regex(words, HEAD, "", max_replacements=1))
        # The tokenizer lower-cases; doing so here first leaves fewer runs.
        runs = pc.if_else(plain, pc.ascii_lower(runs), runs).dictionary_encode()
        rest = rest.dictionary_encode()
        # Those of ASCII letters first.
        other = pc.invert(pc.string_is_ascii(runs.dictionary)).to_numpy(zero_copy_only=False)
        order = np.argsort(other, kind="stable")
        letters, place, n_ascii = runs.dictionary.take(pa.array(order)), np.argsort(order), len(order) - int(other.sum())
        blank = pc.index(letters, "").as_py()  # stands for words that don't begin with a run of letters; -1: none
        letters = pc.if_else(pc.equal(letters, ""), "a", letters)
        flat, size = (np.concatenate(x) for x in zip(
            self._runs(letters.slice(0, n_ascii), self.bare), self._runs(letters.slice(n_ascii), self.tokenizer),
            self._pieces(rest.dictionary.to_pylist())))
        start = np.cumsum(size) - size
        if blank >= 0:
            size[blank] = 0
        pieces = np.stack([place[np.asarray(runs.indices)], np.asarray(rest.indices) + len(letters)], axis=1)
        del words, runs, rest, letters, plain
        pa.default_memory_pool().release_unused()
        # First the ids of each distinct word, then those of the texts.
        flat, ends = _gathered(flat, start, size, pieces.ravel())
        word_start = ends[:-1:2]
        word_size = ends[2::2] - word_start
        out = []
        for k in range(0, len(texts), 512):  # bounds the arrays
            part = edges[k:min(k + 512, len(texts)) + 1]
            ids, ends = _gathered(flat, word_start, word_size, at[part[0]:part[-1]])
            cuts = (ends[part - part[0]] * flat.itemsize).tolist()
            ids = ids.tobytes()
            out.extend(ids[i:j] for i, j in zip(cuts, cuts[1:]))
        return out


def _joined(strings: pa.Array, separator: str) -> str:
    import pyarrow.compute as pc
    return pc.binary_join(pa.ListArray.from_arrays([0, len(strings)], strings), separator)[0].as_py()


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``flat[start : start + size]`` that ``pick`` names, in a row, and where each ends."""
    n = size[pick]
    ends = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(start[pick] - ends[:-1], n) + np.arange(ends[-1])], ends


def load_tokenizer(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def without_cache(tokenizer):
    """The same tokenizer with a model that keeps no memory of words: where
    each word comes once, that is only filled and missed."""
    from tokenizers.models import BPE
    model = {k: v for k, v in json.loads(tokenizer.to_str())["model"].items() if v is not None}
    if model.pop("type") == "BPE":
        model["merges"] = [tuple(m) for m in model["merges"]]
        tokenizer.model = BPE(cache_capacity=0, **model)
    return tokenizer


def id_type(path: str) -> str:
    """Two bytes an id where the vocabulary allows it (while ids are on their way; readers get four)."""
    return "<u2" if load_tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


def _blocks(batches):
    """Batches put together to tables of about BLOCK_BYTES."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
            end_id: int = END_ID) -> DataFrame:
    """(_kind, _id, _ids, _n): kind 0 has the packed ids of each row, end id
    included; kind 1 has each task's number of uses of every id."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    dtype = id_type(path)
    end = np.array([end_id], dtype=dtype).tobytes()

    def run(batches):
        encoder = WordEncoder(path, dtype)
        total = np.zeros(max(len(encoder.ends), end_id + 1), dtype=np.int64)
        for b in _blocks(batches):
            coded = encoder.encode(b.column(1).fill_null("").combine_chunks())
            for start in range(0, len(coded), 512):
                ids = [x + end for x in coded[start:start + 512]]
                np.add(total, np.bincount(np.frombuffer(b"".join(ids), dtype=dtype), minlength=len(total)), out=total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(ids), dtype=np.int32)),
                     b.column(0).slice(start, len(ids)).combine_chunks(), pa.array(ids, pa.binary()),
                     pa.array([len(x) // len(end) for x in ids], pa.int64())], names=["_kind", "_id", "_ids", "_n"])
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([None], pa.int64()),
                                          pa.array([total.tobytes()], pa.binary()), pa.array([0], pa.int64())],
                                         names=["_kind", "_id", "_ids", "_n"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        run, "_kind int, _id long, _ids binary, _n long")


def id_counts(rows: DataFrame) -> DataFrame:
    """(id, n) over the tasks' counts."""
    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for b in batches:
            for x in b.column(0):
                n = np.frombuffer(x.as_buffer(), dtype=np.int64)
                total = n + total if len(total) else n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return rows.select("_ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that add up to ``2**bits``, each at least 1."""
    size = 1 << bits
    if len(counts) > size // 2:
        raise ValueError(f"{len(counts)} distinct ids need more than {bits} scale bits")
    f = np.maximum(1, np.floor(counts * (size / counts.sum()))).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    excess = int(f.sum()) - size
    k = 0
    while excess > 0:  # taken off the most frequent ids
        take = min(excess, int(f[order[k]]) // 2)
        f[order[k]] -= take
        excess, k = excess - take, k + 1
    f[order[0]] -= excess
    return f


class Coder:
    """Static rANS over a shared table of ids and frequencies."""

    def __init__(self, ids: np.ndarray, freqs: np.ndarray, bits: int = SCALE_BITS, lanes: int = LANES,
                 step: int = STEP):
        self.bits, self.lanes, self.step = bits, lanes, step
        self.ids = ids.astype(np.uint32)
        self.freq = freqs.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freqs)[:-1]]).astype(np.uint64)
        self.rank = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=np.int64)
        self.rank[ids] = np.arange(len(ids))
        self.slots: np.ndarray | None = None

    def encode(self, tokens: np.ndarray) -> bytes:
        lanes, bits = self.lanes, np.uint64(self.bits)
        n = len(tokens)
        ranks = self.rank[tokens]
        steps = -(-n // lanes)
        state = np.full(lanes, LOW, dtype=np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        size = 0
        for s in range(steps - 1, -1, -1):
            r = ranks[s * lanes:(s + 1) * lanes]
            x = state[:len(r)]
            f = self.freq.take(r)
            full = x >= f << (np.uint64(63) - bits)
            if full.any():
                words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                size += len(words[-1])
                x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            state[:len(r)] = (q << bits) + (x - q * f) + self.start.take(r)
            if s % self.step == 0:
                marks.append((size, state.copy()))
        span = self.step * lanes
        head = [struct.pack(_HEAD, MAGIC, 1, lanes, n, size, len(marks))]
        for c, (before, lane) in enumerate(reversed(marks)):
            check = zlib.crc32(tokens[c * span:(c + 1) * span].astype("<u4").tobytes())
            head.append(struct.pack("<2I", before, check) + lane.astype("<u8").tobytes())
        return b"".join(head + [w.tobytes() for w in words])

    def decode(self, payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of checkpoint ranges ``first`` to ``last`` (all by default), checked."""
        magic, version, lanes, n, size, marks = struct.unpack_from(_HEAD, payload)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token block")
        if self.slots is None:
            self.slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        each = 8 + 8 * lanes
        words = np.frombuffer(payload, dtype="<u4", count=size, offset=_HEAD_SIZE + marks * each)
        bits, low = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        out = []
        for c in range(first, marks if last is None else last):
            at = _HEAD_SIZE + c * each
            before, check = struct.unpack_from("<2I", payload, at)
            state = np.frombuffer(payload, dtype="<u8", count=lanes, offset=at + 8).astype(np.uint64)
            part = np.empty(min(n - c * self.step * lanes, self.step * lanes), dtype=np.int64)
            for j in range(0, len(part), lanes):
                x = state[:len(part) - j]
                slot = x & low
                r = self.slots.take(slot.view(np.int64)).astype(np.int64)
                part[j:j + lanes] = r
                x = self.freq.take(r) * (x >> bits) + slot - self.start.take(r)
                short = np.flatnonzero(x < LOW)
                k = len(short)
                if k:
                    x[short] = (x[short] << np.uint64(32)) | words[before - k:before]
                    before -= k
                state[:len(x)] = x
            ids = self.ids.take(part)
            if zlib.crc32(ids.astype("<u4").tobytes()) != check:
                raise ValueError(f"checksum of ids differs at checkpoint {c}")
            out.append(ids)
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


BLOCKS = ("part int, block int, start_in_part long, n_tokens long, doc_ids array<long>, doc_starts array<long>, "
          "payload binary, payload_crc32 long")


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str | None = None, end_id: int = END_ID, part_tokens: int = PART_TOKENS,
                 block_tokens: int = BLOCK_TOKENS) -> str:
    """Encode all rows and write the two tables under ``path``."""
    spark = docs.sparkSession
    dtype = id_type(tokenizer or public_tokenizers.path(TOKENIZER))
    every = written(encoded(docs, id_col, text_col, tokenizer, end_id), "token_ids", "zstd", ["_kind"])
    rows = every.where("_kind = 0").select("_id", "_ids", "_n")
    counts = id_counts(every.where("_kind = 1")).orderBy("id").toArrow()  # one row an id of the vocabulary
    ids, n = (np.asarray(counts.column(c)) for c in ("id", "n"))
    freqs = scaled(n) if len(n) else n
    spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(ids, n, freqs)],
                          "id long, n long, freq long").coalesce(1).write.parquet(f"{path}/frequencies")
    shared = spark.sparkContext.broadcast((ids, freqs))

    keyed = rows.withColumn("_d", doc_key(F.col("_id")))
    cuts = quantile_cuts(keyed, "_d", min(MAX_PARTS, max(1, int(n.sum()) // part_tokens)))
    dealt = (keyed.withColumn("_part", range_number(F.col("_d"), cuts)).repartitionById(len(cuts) + 1, "_part")
             .sortWithinPartitions("_part", F.asc_nulls_first("_id"), "_ids"))

    def encode(batches):
        coder, width = Coder(*shared.value), int(dtype[-1])
        held, size, now, block, before = [], 0, None, 0, 0

        def flush():
            buffers = [x for _, x in held]
            tokens = np.frombuffer(b"".join(buffers), dtype=dtype)
            starts = np.cumsum([0] + [len(x) // width for x in buffers])[:-1]
            payload = coder.encode(tokens)
            return pa.RecordBatch.from_arrays([
                pa.array([now], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()),
                pa.array([len(tokens)], pa.int64()),
                pa.array([[i for i, _ in held]], pa.list_(pa.int64())), pa.array([starts.tolist()], pa.list_(pa.int64())),
                pa.array([payload], pa.binary()), pa.array([zlib.crc32(payload)], pa.int64())],
                names=["part", "block", "start_in_part", "n_tokens", "doc_ids", "doc_starts", "payload", "payload_crc32"])

        for b in batches:
            for p, i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if held and (p != now or size + len(x) // width > block_tokens):
                    yield flush()
                    held, size, block, before = [], 0, block + 1, before + size
                if p != now:
                    now, block, before = p, 0, 0
                held.append((i, x))
                size += len(x) // width
        if held:
            yield flush()

    dealt.select("_part", "_id", "_ids").mapInArrow(encode, BLOCKS).write.parquet(f"{path}/blocks")
    # One number a part of PART_TOKENS ids; only these are summed in one place.
    (spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n"))
     .withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(
         Window.unboundedPreceding, -1)), F.lit(0))).write.parquet(f"{path}/parts"))
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files: blocks
    are decoded independently, ``start`` counts the ids of all documents before."""
    shared = spark.sparkContext.broadcast(tuple(
        np.asarray(spark.read.parquet(f"{path}/frequencies").orderBy("id").toArrow().column(c)) for c in ("id", "freq")))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    parts = spark.read.schema("part int, n long, before long").parquet(f"{path}/parts")

    def decode(batches):
        coder = Coder(*shared.value)
        for b in batches:
            for part, block, start, n, docs, offsets, payload, check in zip(*[c.to_pylist() for c in b.columns]):
                if zlib.crc32(payload) != check:
                    raise ValueError(f"checksum of block {part}/{block} differs")
                ids = coder.decode(payload)
                ends = offsets[1:] + [n]
                k = len(docs)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * k, pa.int32()), pa.array(docs, pa.int64()),
                    pa.array([start + o for o in offsets], pa.int64()), pa.array([e - o for o, e in zip(offsets, ends)], pa.int64()),
                    pa.array([ids[o:e].astype("<u4").tobytes() for o, e in zip(offsets, ends)], pa.binary())],
                    names=["part", "doc_id", "_at", "n_tokens", "ids"])

    out = blocks.mapInArrow(decode, "part int, doc_id long, _at long, n_tokens long, ids binary")
    return out.join(parts, "part").select("doc_id", (F.col("before") + F.col("_at")).alias("start"), "n_tokens", "ids")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = write_tokens(docs, scratch_path(spark, "token_store"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
