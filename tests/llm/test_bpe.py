import base64
import random

import numpy as np
import public_tokenizers as T
import pytest
import tiktoken

from chainlens.llm import bpe as B
from llm_util import AWKWARD, prose, table


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(T.path(B.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows_of():
    rng = random.Random(23)
    rows = [(i, prose(rng, ("en", "de", "fr")[i % 3]), "en", "s") for i in range(80)]
    rows += [(200, "a" * 5000, "en", "s"), (201, "the " * 100_000, "en", "s"), (202, "  \t\n  x  \n\n y<|endoftext|>", "en", "s"),
             (203, "".join(chr(rng.randrange(0x20, 0xD7FF)) for _ in range(3000)), "en", "s")]
    return rows + AWKWARD


@pytest.mark.parametrize("block", [300, B.BLOCK_CHARS])
def test_equals_tiktoken_and_round_trip(spark, reference, block):
    rows = rows_of()
    out = B.decode(B.encode(table(spark, rows), block_chars=block)).collect()
    got = sorted([(r["_id"], np.frombuffer(r["ids"], dtype="<u4").tolist(), bytes(r["decoded"])) for r in out], key=str)
    assert got == sorted([(i, reference.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows], key=str)


def test_long_merges(reference):
    ranks = B.load_ranks(T.path(B.RANKS))
    rng = random.Random(1)
    for n in (201, 260, 900):
        for letters in ("ab", "etaoinshr", "x", "é"):
            w = "".join(rng.choice(letters) for _ in range(n))
            assert B.merged(w.encode(), ranks) == reference.encode_ordinary(w)


def test_one_list_a_block_and_bucket(spark):
    words = B.distinct_words(table(spark, rows_of()).selectExpr("doc_id _id", "text _text"), 300, 4)
    assert words.groupBy("block", "bucket").count().where("count > 1").count() == 0


def test_empty(spark):
    assert B.digests(table(spark, rows_of()).where("false")).count() == 0
