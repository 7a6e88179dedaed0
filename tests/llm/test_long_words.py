"""Words of any length: equal to the library, in time and memory that grow with the word."""

import random
import time

import public_tokenizers
import pytest
import tiktoken

from crawlspark.llm import byte_bpe as B
from crawlspark.llm.common import Remembered


@pytest.fixture(scope="module")
def codec():
    ranks = B.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return B.Codec(ranks, B.merge_table(ranks))


@pytest.fixture(scope="module")
def library():
    ranks = B.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def letters(n, seed=1):
    return "".join(random.Random(seed).choices("abcdefghijklmnopqrstuvwxyz", k=n))


def test_long_words_equal_the_library(codec, library):
    rnd = random.Random(3)
    texts = [letters(n, n) for n in (65, 200, 201, 5000)] + [" " * 3001, "é" * 900, "=" * 700, "ab" * 600, "日本" * 300]
    texts += ["".join(rnd.choices("ab", k=rnd.randrange(60, 400))) for _ in range(200)]
    text_codec = B.TextCodec(codec, public_tokenizers.PATTERN)
    for text, (ids, plain) in zip(texts, text_codec([t.encode() for t in texts])):
        assert [int.from_bytes(ids[i:i + 4], "little") for i in range(0, len(ids), 4)] == library.encode_ordinary(text)
        assert plain == text.encode()


@pytest.mark.parametrize("text", [" " * 3_000_000, "x" * 3_000_000, letters(1_000_000)])
def test_megabytes_in_one_match(codec, text):
    start = time.perf_counter()
    (ids, plain), = B.TextCodec(codec, public_tokenizers.PATTERN)([text.encode()])
    assert plain == text.encode() and len(ids) % 4 == 0 and time.perf_counter() - start < 60


def test_remembered_keeps_what_is_used():
    table = Remembered(4)
    for k in range(50):
        table.rest()
        for key in table.unknown({"often", k}):
            table[key] = str(key)
        assert table["often"] == "often" and table[k] == str(k) and len(table) + len(table.old) <= 8
    assert table.unknown(["often", 0]) == [0]
