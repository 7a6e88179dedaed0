import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from conftest import ODD_TEXTS, by_row
from hypothesis import given, settings
from hypothesis import strategies as st

from crawlspark.llm import byte_bpe as B

FILE = P.path("byte_bpe_50k.tiktoken")
RANKS = B.read_ranks(FILE)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = B.TextCodec(B.Codec(RANKS, B.merge_table(RANKS)), P.PATTERN)


def want(text):
    ids = np.array(LIBRARY.encode_ordinary(text or ""), dtype="<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_odd_rows(odd, none):
    got = by_row(B.encode_digests(odd, FILE, P.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(((i, *want(t)) for i, t in ODD_TEXTS), key=lambda r: tuple((x is not None, x) for x in r))
    assert B.encode_digests(none, FILE, P.PATTERN).count() == 0
    ids = {r.doc_id: r.ids for r in B.encode_ids(odd, FILE, P.PATTERN).collect()}
    assert ids[10] == LIBRARY.encode_ordinary(dict(ODD_TEXTS)[10])


def test_whole_documents(docs):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.encode_digests(docs, FILE, P.PATTERN).collect()}
    assert got == {r.doc_id: want(r.text) for r in docs.select("doc_id", "text").collect()}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab A1é½日 \n\t \x85\xa0'sréll.!-=\x1c"), max_size=30), max_size=3))
def test_equals_the_library(texts):
    for text, (ids, plain) in zip(texts, CODEC([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode_ordinary(text)
        assert plain == text.encode()


def test_long_words_take_the_same_merges():
    for word in (b"a" * 3000, b"=" * 2500, b"ab" * 900, "é".encode() * 700, bytes(range(33, 127)) * 12, b"th" * 400 + b"e"):
        (ids, plain), = CODEC.codec.encode([word])
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY._core_bpe.encode_single_piece(word) and plain == word


def test_a_vocabulary_must_hold_every_byte():
    with pytest.raises(ValueError):
        B.Codec({b"a": 0}, B.merge_table({b"a": 0}))


def test_a_piece_is_looked_up_once_for_many_texts(monkeypatch):
    looked_up = []

    class Counting(B.Remembered):
        def __getitem__(self, key):
            looked_up.append(key)
            return super().__getitem__(key)

    monkeypatch.setattr(B, "Remembered", Counting)
    texts = ["one two, three's.\nfour " * 500] * 4
    for text, (ids, plain) in zip(texts, B.TextCodec(CODEC.codec, P.PATTERN)([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode_ordinary(text) and plain == text.encode()
    assert len(looked_up) < 60


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é×÷ªǅ\u0301½.,'\n\t\r\x0b \xa0\u2028\u3000\u2003日s1\x1c\x00"), max_size=24), max_size=4))
def test_texts_part_where_the_pattern_cuts(texts):
    for text, (ids, plain) in zip(texts, CODEC([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode_ordinary(text) and plain == text.encode()


def test_broken_utf8_is_read_as_the_library_reads_it():
    texts = [b"a\xc3", b"\xa9b", b"\xff x\xff\xff", b"", b"ok"]
    for text, (ids, plain) in zip(texts, CODEC(texts), strict=True):
        whole = text.decode("utf-8", "replace")
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode_ordinary(whole) and plain == whole.encode()
