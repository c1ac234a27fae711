import os
import random

import pytest

from quernmill.llm.bpe import BYTE_BPE_50K, RankBPE, count_tokens, encode, read_ranks

pytestmark = pytest.mark.skipif(not os.path.exists(BYTE_BPE_50K), reason="no vocabulary")

TEXTS = ["", " ", "hello world", "don't I'LL we're", "  \n\n  a  ", "<|endoftext|>", "naïve 日本語 👩‍🍳", "\x1c\x1d x\x00\x85\xa0 　y", "a" * 3000, "ab" * 700, "é" * 400, " " * 900, "1234567890" * 40, "ⅷ²½ ١٢٣", "﻿x᠎y​z"]


@pytest.fixture(scope="module")
def bpe():
    with open(BYTE_BPE_50K, "rb") as f:
        return RankBPE(read_ranks(f.read()))


@pytest.fixture(scope="module")
def public(bpe):
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks, special_tokens={})


def test_ids_and_round_trip(bpe, public):
    rng = random.Random(2)
    pool = [chr(c) for c in [*range(1, 0x250), *range(0x2000, 0x2070), 0x3000, 0x4E00, 0x1F600]]
    back = {i: b for b, i in bpe.ranks.items()}
    for text in [*TEXTS, *("".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(800))]:
        ids = bpe.encode(text)
        assert ids == public.encode_ordinary(text)
        assert b"".join(back[i] for i in ids).decode() == text


def test_both_merges_agree(bpe):
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choice("abcdeinorst é") for _ in range(rng.randint(1, 80))).encode()
        assert bpe.merge(word) == bpe.merge_long(word)


def test_operator(spark, bpe):
    df = spark.createDataFrame([(1, "hello hello", "x"), (2, None, "y"), (3, "", None), (None, "hi", "z"), (1, "hello hello", "x")], "doc_id bigint, text string, ids string")
    got = sorted(map(tuple, encode(df, "text", ["doc_id"]).collect()), key=repr)
    assert got == sorted([(1, bpe.encode("hello hello")), (2, []), (3, []), (None, bpe.encode("hi")), (1, bpe.encode("hello hello"))], key=repr)
    assert encode(df, "text", ["doc_id", "ids"]).columns == ["doc_id", "ids", "ids_"]
    assert dict(count_tokens(df, "text", ["doc_id"]).where("doc_id > 1").collect()) == {2: 0, 3: 0}
    assert encode(df.limit(0), "text", ["doc_id"]).count() == 0
