import random
import struct
import sys
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from chainlens.llm import token_store as S
from chainlens.session import scratch_path
from llm_util import AWKWARD, prose, table


def rows_of():
    rng = random.Random(19)
    rows = [(i * 2, prose(rng, ("en", "de", "fr")[i % 3], lines=rng.randint(1, 5)), "en", "s") for i in range(150)]
    rows += [(901, "<|endoftext|> and <|startoftext|>", "en", "s"), (950, "a'b c-d..' 'll é Σας x y z w …»!", "en", "s"),
             (951, "hot " * 80_000, "en", "s"), (40, "same id", "en", "s")]
    return rows + AWKWARD


def want(rows):
    t = Tokenizer.from_file(public_tokenizers.path(S.TOKENIZER))
    coded = []
    for i, x, *_ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        coded.append((i, ids, struct.pack(f"<{len(ids)}H", *ids)))
    coded.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    out, start = [], 0
    for i, ids, _ in coded:
        out.append((i, start, len(ids), struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    return sorted(out, key=str)


@pytest.mark.parametrize("part,block", [(2000, 700), (S.PART_TOKENS, S.BLOCK_TOKENS)])
def test_round_trip(spark, part, block):
    rows = rows_of()
    path = S.write_tokens(table(spark, rows), scratch_path(spark, "tok"), part_tokens=part, block_tokens=block)
    got = sorted([(r[0], r[1], r[2], bytes(r[3])) for r in S.read_tokens(spark, path).collect()], key=str)
    assert got == want(rows)


def test_ids_equal_the_plain_library_call():
    """Every letter whose normal form differs from itself, beside punctuation; special-token strings; random mixes."""
    path = public_tokenizers.path(S.TOKENIZER)
    plain, encoder = Tokenizer.from_file(path), S.WordEncoder(path, "<u2")
    odd = [c for c in map(chr, range(0x80, 0x30000)) if c.isalpha() and (
        unicodedata.normalize("NFC", c) != c or unicodedata.normalize("NFD", c) != c or len(c.lower()) > 1)]
    odd = [c for c in odd if not 0xAC00 <= ord(c) <= 0xD7A3] + ["\uac00", "\ud7a3"]
    texts = [x for c in odd for x in (c + ")", "a" + c + "!?", c + " " + c + ".", c.upper() + "a,")]
    texts += ["\u0130)", "end <|endoftext|> more", "a<|endoftext|>b.", "<|startoftext|>", "<|endoftext|", "x<|ENDOFTEXT|>", "it's)'ll!"]
    rng = random.Random(4)
    pool = odd + list("abcXYZ019'.,!?()<>|_- \n\t\u00a0\u3000\u0301\u0338\u05bc\u0e31\u200d\ud55c日é\U0001f600") + ["<|endoftext|>"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    got = encoder.encode(pa.array(texts))
    for t, x in zip(texts, got):
        assert np.frombuffer(x, "<u2").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


class Watched:
    """A tokenizer that notes how many Python objects there are when it is called."""

    def __init__(self, tokenizer):
        self.tokenizer, self.objects = tokenizer, []

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **options):
        self.objects.append(sys.getallocatedblocks())
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_distinct_words_are_no_python_objects():
    """The words of a block stay in Arrow up to the library call, and its ids are those of the plain call."""
    path = public_tokenizers.path(S.TOKENIZER)
    rng = random.Random(8)
    words = list({"".join(rng.choice("abcdeéüA") for _ in range(rng.randint(6, 9))) + rng.choice(("", ",", ".", "!?"))
                  for _ in range(60_000)})
    texts = pa.array([" ".join(words[k:k + 1000]) for k in range(0, len(words), 1000)])
    encoder, plain = S.WordEncoder(path, "<u2"), Tokenizer.from_file(path)
    encoder.encode(texts.slice(0, 1))  # tables that are made once
    encoder.tokenizer = Watched(encoder.tokenizer)
    before = sys.getallocatedblocks()
    got = encoder.encode(texts)
    assert max(encoder.tokenizer.objects) - before < len(words) // 10
    for t, x in zip(texts.to_pylist()[::10], got[::10]):
        assert np.frombuffer(x, "<u2").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_tokenizer_without_its_cache_is_the_same():
    path = public_tokenizers.path(S.TOKENIZER)
    plain, ours = Tokenizer.from_file(path), S.without_cache(S.load_tokenizer(path))
    assert ours.to_str() == plain.to_str()
    for t in ("it's <|endoftext|> 2nd", "\u0130) \u00c9T\u00c9", "H\u0331!", ""):
        assert ours.encode(t, add_special_tokens=False).ids == plain.encode(t, add_special_tokens=False).ids


def test_ascii_runs_skip_steps_that_keep_them():
    """Runs of ASCII letters go to a tokenizer of the same model alone, all others to the whole one."""
    path = public_tokenizers.path(S.TOKENIZER)
    encoder, plain = S.WordEncoder(path, "<u2"), Tokenizer.from_file(path)
    assert encoder.bare.normalizer is None and encoder.bare is not encoder.tokenizer
    rng = random.Random(12)
    letters = "esthrondlmvIKS" * 9 + "éÉßİΣ한"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) + rng.choice(("", ",", "'s")) for _ in range(300))
             for _ in range(100)]
    for t, x in zip(texts, encoder.encode(pa.array(texts))):
        assert np.frombuffer(x, "<u2").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_ascii_runs_keep_the_steps_of_a_tokenizer_that_changes_them(tmp_path):
    from tokenizers import Regex, normalizers, pre_tokenizers
    own = Tokenizer.from_file(public_tokenizers.path(S.TOKENIZER))
    own.normalizer = normalizers.Sequence([own.normalizer, normalizers.Replace(Regex("q"), "k")])
    own.save(str(tmp_path / "own.json"))
    encoder = S.WordEncoder(str(tmp_path / "own.json"), "<u2")
    assert encoder.bare is encoder.tokenizer
    added = Tokenizer.from_file(public_tokenizers.path(S.TOKENIZER))
    added.add_tokens(["uick"])
    added.save(str(tmp_path / "added.json"))
    whole = S.WordEncoder(str(tmp_path / "added.json"), "<u2")
    assert whole.bare is whole.tokenizer
    assert np.frombuffer(encoder.encode(pa.array(["quick quiet"]))[0], "<u2").tolist() == own.encode("quick quiet").ids


@pytest.mark.parametrize("texts", [[], [""], [" ", ""], ["."], ["a"], ["!a"], ["'s", "A.", "\u0130)"]])
def test_blocks_without_runs_or_tails(texts):
    path = public_tokenizers.path(S.TOKENIZER)
    plain, got = Tokenizer.from_file(path), S.WordEncoder(path, "<u2").encode(pa.array(texts, pa.string()))
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_coder_checkpoints_and_checksums():
    rng = np.random.default_rng(3)
    ids = np.sort(rng.choice(50_000, 3000, replace=False))
    counts = rng.zipf(1.3, 3000) + 0
    freqs = S.scaled(counts)
    assert freqs.sum() == 1 << S.SCALE_BITS and freqs.min() >= 1
    coder = S.Coder(ids, freqs, lanes=64, step=8)
    for n in (1, 63, 64, 65, 5000):
        tokens = rng.choice(ids, n, p=counts / counts.sum())
        data = coder.encode(tokens)
        assert (coder.decode(data) == tokens).all()
        last = -(-n // 512)
        assert (coder.decode(data, last - 1) == tokens[(last - 1) * 512:]).all()  # from a checkpoint only
    broken = bytearray(data)
    broken[-256:] = bytes(b ^ 0x5A for b in broken[-256:])
    with pytest.raises(ValueError):
        coder.decode(bytes(broken))
    tokens = rng.choice(ids, 200_000, p=counts / counts.sum())
    p = counts / counts.sum()
    bits = -(np.log2(p[np.searchsorted(ids, tokens)])).sum()
    assert len(S.Coder(ids, freqs).encode(tokens)) * 8 < 1.2 * bits + 64 * S.LANES * 2


def test_damaged_block_is_found(spark):
    from pyspark.sql import functions as F
    path = S.write_tokens(table(spark, rows_of()[:20]), scratch_path(spark, "tok"))
    bad = scratch_path(spark, "tok")
    for name in ("frequencies", "parts"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{bad}/{name}")
    spark.read.parquet(f"{path}/blocks").withColumn("payload_crc32", F.col("payload_crc32") + 1).write.parquet(f"{bad}/blocks")
    with pytest.raises(Exception, match="checksum"):
        S.read_tokens(spark, bad).collect()
    assert zlib.crc32(b"") == 0


def test_empty(spark):
    path = S.write_tokens(table(spark, rows_of()).where("false"), scratch_path(spark, "tok"))
    assert S.read_tokens(spark, path).count() == 0
