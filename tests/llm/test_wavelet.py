import zlib

import numpy as np
import public_tokenizers as P
import pytest
from conftest import ODD_TEXTS
from tokenizers import Tokenizer

from crawlspark.llm import wavelet as W

with open(P.path("word_bpe_49k.json"), encoding="utf-8") as _f:
    DEFINITION = _f.read()
LIBRARY = Tokenizer.from_str(DEFINITION)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("n", [0, 1, 7, 8, 511, 512, 513, 5000])
def test_matrix_answers_like_the_ids(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.4, n) % 49408).astype(np.uint16)
    m = W.WaveletMatrix.from_bytes(W.WaveletMatrix.build(ids).to_bytes())
    assert (m.tokens() == ids).all() and m.n == n
    for i in rng.integers(0, n, 40) if n else []:
        assert m.access(int(i)) == ids[i]
    for token in {*ids[:20].tolist(), 0, 49407}:
        where = np.flatnonzero(ids == token)
        assert m.count(token) == len(where) and m.count(token, n // 3, n) == (where >= n // 3).sum()
        for k in range(min(4, len(where))):
            assert m.locate(token, k) == where[k]
        assert m.locate(token, len(where)) == -1
    with pytest.raises(IndexError):
        m.access(n)


def test_encoder_equals_the_library():
    texts = [t or "" for _, t in ODD_TEXTS] + ["Don't STOP 12345 ½", "İstanbul ΑΣ ΑΣ.", "é ̈x", "ﬁ Å   x y", "a\x00b"]
    got = W.WordEncoder(DEFINITION)([t.encode() for t in texts])
    for text, data in zip(texts, got):
        assert np.frombuffer(data, "<u2").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_whole_documents_from_the_files(docs):
    got = sorted(W.token_index(docs, DEFINITION, file_tokens=5000).collect())
    at = 0
    for r, d in zip(got, sorted(docs.select("doc_id", "text").collect()), strict=True):
        ids = ids_of(d.text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), crc(ids))
        at += len(ids)


def test_odd_rows(odd, none):
    got = sorted(W.token_index(odd, DEFINITION).collect(), key=lambda r: r.start)
    assert [r.doc_id is not None for r in got] == [False] + [True] * (len(ODD_TEXTS) - 1)
    assert [r.doc_id for r in got[1:]] == sorted(i for i, _ in ODD_TEXTS if i is not None)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(ids_of(t)), crc(ids_of(t))) for _, t in ODD_TEXTS)
    assert W.token_index(none, DEFINITION).count() == 0


def test_a_piece_is_looked_up_once_for_many_texts():
    class Counting(W.Remembered):
        looked_up = 0

        def __getitem__(self, key):
            self.looked_up += 1
            return super().__getitem__(key)

    encoder = W.WordEncoder(DEFINITION)
    encoder.pieces = Counting(1000)
    texts = ["one two, three. four " * 500] * 4
    for text, data in zip(texts, encoder([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(data, "<u2").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert encoder.pieces.looked_up < 50


@pytest.mark.parametrize("texts", [[], [""], ["", "", ""], ["."], [",", " .", ". "], ["a.", "b,", "c. d, e.f 1, é. ."], [" ", "\n\n", "x"],
                                   ["a\x0bb\x0cc\x1cd\r\ne\tf", "", "A. B,\n", "end."], ["<|endoftext|> a.", "a. <|endoftext|>", "a."]])
def test_texts_part_where_they_end(texts):
    got = W.WordEncoder(DEFINITION)([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_letters_part_from_what_follows_them():
    texts = ["An$$$ an### an! é. é, é&&& 5-5", "an.\nan\n", "≮ a≮ İ. İx", "don't a's"]
    encoder = W.WordEncoder(DEFINITION)
    distinct, places, ends = encoder._split([t.encode() for t in texts[:2]])
    assert {*distinct} == {b"an", b"$$$", b"###", b"!", "é".encode(), b".", b",", b"&&&", b"5", b"-5"}
    assert [distinct[p] for p in places[ends[0]:ends[1]]] == [b"an", b".", b"an"]
    for text, data in zip(texts, encoder([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(data, "<u2").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
