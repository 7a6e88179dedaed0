"""Byte-level BPE in recursive DuckDB queries, one in-memory database for each task.

A text is cut by the pattern into words. A word that is in the vocabulary is its own token; the other distinct words
become token-position rows. Each step of the recursion joins the rows' pairs with the merge table and contracts, in
every word, the leftmost pair of lowest rank; a word without such a pair leaves as it is. Decoding joins the ids with the
vocabulary and aggregates the bytes in the order of the positions; every distinct word is held against what its ids
decode to. A document's bytes are decoded from its own ids, by the same vocabulary and order.

Words longer than ``LONG_WORD`` bytes are merged by a heap of (rank, position) over a linked list of tokens, the same
contractions in the same order in n log n steps and some hundred bytes of memory for each byte of the word. Their ids are
decoded by the same query as those of the others, in blocks of rows.

Where a run of letters or of white space ends, the pattern cuts whatever stands around it. So texts are parted there in
Arrow, and each distinct piece, mostly a word, is cut, encoded and looked up once for a slab of texts.

Defined cases: a null or empty text has no token and the digests of no bytes; repeated rows and equal doc_ids stay as
rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import Remembered, gathered, kept_in_worker, per_text

SLAB = 4 << 20           # bytes of text whose distinct words are encoded together
LONG_WORD = 64           # bytes
QUERY_BYTES = 1 << 18    # token-position rows of one query
KEPT_WORDS = 600_000     # encoded pieces that a worker remembers
BREAK = "\u2028"         # white space that separates pieces while they are cut
WHITE = r"\t-\r \x85\xa0  -     　"
GID = (1 << 40) - 1
TEXT_END = b"\xff"       # in no UTF-8 text

# Kinds of bytes: ASCII letters, the second byte of a letter from U+00C0 to U+00FF, white space, other ASCII, the end.
LETTER, LATIN, SPACE, OTHER, END = 1, 2, 3, 4, 5
KINDS = bytes([LETTER if b < 0x80 and chr(b).isalpha() else SPACE if chr(b) in " \t\n\x0b\x0c\r" else OTHER if b < 0x80
               else LATIN if b < 0xC0 and b not in (0x97, 0xB7) else END if b == TEXT_END[0] else 0 for b in range(256)])
# Letters up to U+024F, a space before them or not: one word.
ONE_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+").fullmatch

SHORT_SQL = f"""
WITH RECURSIVE state(word, gid, tok, live) AS (
  SELECT word, gid, tok, true FROM start
  UNION ALL
  SELECT word, gid, tok, live FROM (
    WITH pairs AS (
      SELECT word, gid, tok, lag(gid) OVER w AS prev,
             CASE WHEN lead(word) OVER w = word THEN tok::BIGINT * 65536 + lead(tok) OVER w END AS pair
      FROM state WHERE live WINDOW w AS (ORDER BY gid)),
    ranked AS MATERIALIZED (
      SELECT p.word, p.gid, p.prev, p.tok, (m.rank::BIGINT << 40) | p.gid AS place
      FROM pairs p LEFT JOIN merges m ON p.pair = m.pair),
    lowest AS (SELECT word, min(place) AS low FROM ranked GROUP BY word)
    SELECT r.word, r.gid, CASE WHEN r.place = l.low THEN (l.low >> 40)::INTEGER ELSE r.tok END AS tok,
           l.low IS NOT NULL AS live
    FROM ranked r JOIN lowest l USING (word)
    WHERE l.low IS NULL OR r.prev IS NULL OR r.prev <> l.low & {GID}))
SELECT word, gid, tok FROM state WHERE NOT live
"""

# Decoding: the bytes of the ids in the order of the positions, in blocks of words.
DECODE_SQL = """
SELECT d.word >> 10 AS block, string_agg(v.hex, '' ORDER BY d.gid) AS hex
FROM done d JOIN vocabulary v ON v.tok = d.tok GROUP BY block ORDER BY block
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes, a space and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens whose bytes together are a token, with its rank, which is also its id."""
    rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks]
    left, right, rank = (np.array(x, dtype=np.int64) for x in zip(*rows)) if rows else (np.empty(0, np.int64),) * 3
    return pa.table({"pair": left * 65536 + right, "rank": rank.astype(np.int32)})


def word_pattern(pattern: str) -> regex.Pattern:
    """The pattern with white space spelled out as Unicode's White_Space property."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))


class Codec:
    """Encodes and decodes distinct words in one in-memory database."""

    def __init__(self, ranks: dict[bytes, int], merges: pa.Table, memory: str = "200MB"):
        if ranks and (max(ranks.values()) >= 65536 or any(bytes([i]) not in ranks for i in range(256))):
            raise ValueError("ranks must be below 65536 and hold every single byte")
        self.ranks = ranks
        self.single = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.lengths = np.zeros(65536, dtype=np.int64)
        self.lengths[list(ranks.values())] = [len(t) for t in ranks]
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.letters = np.frombuffer(b"".join([t for _, t in sorted((i, t) for t, i in ranks.items())]), dtype=np.uint8)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        self.tokens = {i: t for t, i in ranks.items()}
        self.merge_rows, self.merges = merges, None
        self.db.register("merge_rows", merges)
        self.db.register("vocabulary_rows", pa.table({"tok": pa.array(ranks.values(), pa.int32()),
                                                      "hex": [t.hex() for t in ranks]}))
        self.db.execute("CREATE TABLE merges AS FROM merge_rows")
        self.db.execute("CREATE TABLE vocabulary AS FROM vocabulary_rows")

    def encode(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """For each word its ids (little-endian unsigned 32-bit) and the bytes that these ids decode to."""
        out: list = [None] * len(words)
        short, long = [], []
        for i, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is not None:
                out[i] = (whole.to_bytes(4, "little"), self.tokens[whole])
            elif w:
                (short if len(w) <= LONG_WORD else long).append(i)
            else:
                out[i] = (b"", b"")
        held, size = [], 0
        # Words of about the same length take about as many steps, so a query ends with all its words.
        for i in sorted(short, key=lambda i: len(words[i])):
            if held and size + len(words[i]) > QUERY_BYTES:
                self._run(words, held, out)
                held, size = [], 0
            held.append(i)
            size += len(words[i])
        if held:
            self._run(words, held, out)
        for i in long:
            ids = self._merge_long(words[i])
            plain = b"".join([self._decode(np.zeros(len(ids[k:k + QUERY_BYTES]), np.int32), ids[k:k + QUERY_BYTES])
                              for k in range(0, len(ids), QUERY_BYTES)])
            out[i] = (ids.astype("<u4").tobytes(), plain)
        return out

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids: those of its tokens, in the order of their positions."""
        ids = np.frombuffer(b"".join(encoded), "<u4")
        plain, ends = gathered(self.letters, self.starts, self.lengths, ids)
        plain = plain.tobytes()
        cuts = ends[np.concatenate(([0], np.cumsum([len(x) // 4 for x in encoded], dtype=np.int64)))].tolist()
        return [plain[a:b] for a, b in zip(cuts, cuts[1:])]

    def _run(self, words, chosen, out) -> None:
        sizes = [len(words[i]) for i in chosen]
        raw = np.frombuffer(b"".join([words[i] for i in chosen]), dtype=np.uint8)
        self.db.register("start", pa.table({"word": np.repeat(np.arange(len(chosen), dtype=np.int32), sizes),
                                            "gid": np.arange(len(raw), dtype=np.int64), "tok": self.single[raw]}))
        found = self.db.sql(f"SELECT word, tok FROM ({SHORT_SQL}) ORDER BY gid").fetchnumpy()
        self.db.unregister("start")
        word, ids = np.asarray(found["word"]), np.asarray(found["tok"])
        plain = self._decode(word, ids)
        counts = np.bincount(word, minlength=len(chosen))
        ends = np.concatenate(([0], np.cumsum(counts)))
        places = np.concatenate(([0], np.cumsum(self.lengths[ids])))[ends].tolist()
        stream, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        for k, i in enumerate(chosen):
            out[i] = (stream[ends[k]:ends[k + 1]], plain[places[k]:places[k + 1]])

    def _decode(self, word: np.ndarray, ids: np.ndarray) -> bytes:
        """The bytes of the ids, in their order."""
        self.db.register("done", pa.table({"word": word, "gid": np.arange(len(ids)), "tok": ids}))
        plain = bytes.fromhex("".join(h for _, h in self.db.sql(DECODE_SQL).fetchall()))
        self.db.unregister("done")
        return plain

    def _merge_long(self, word: bytes) -> np.ndarray:
        """Ids of a long word: the leftmost pair of lowest rank is contracted until there is none."""
        if self.merges is None:
            self.merges = dict(zip(self.merge_rows["pair"].to_pylist(), self.merge_rows["rank"].to_pylist()))
        rank_of, n = self.merges.get, len(word)
        tok = array("i", self.single[np.frombuffer(word, np.uint8)].tolist())
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        # rank and position in one number; a pair that has changed since is passed over.
        heap = [r << 32 | i for i in range(n - 1) if (r := rank_of(tok[i] << 16 | tok[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if tok[i] < 0 or j >= n or rank_of(tok[i] << 16 | tok[j]) != rank:
                continue
            k, tok[i], tok[j] = after[j], rank, -1
            after[i] = k
            if k < n:
                before[k] = i
                if (r := rank_of(rank << 16 | tok[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank_of(tok[h] << 16 | rank)) is not None:
                heapq.heappush(heap, r << 32 | h)
        ids = np.frombuffer(tok, dtype=np.int32)
        return ids[ids >= 0]


class TextCodec:
    """Whole texts, by way of their distinct pieces: a piece is looked up once for all texts of a call."""

    def __init__(self, codec: Codec, pattern: str, kept: int = KEPT_WORDS):
        self.codec = codec
        self.find = word_pattern(pattern).findall
        self.white = set(regex.findall(f"[{WHITE}]", "".join(map(chr, range(0x3001)))))
        self.other_white = re.compile(b"|".join([c.encode() for c in sorted(self.white) if not c.isascii()]))
        self.known = Remembered(kept)

    def split(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct pieces, every piece of the texts as a place among them, and how many pieces end with each text.

        The pattern cuts after a letter that something else follows, before white space, before its last character
        where more text follows, and behind that if it is not a space; what stands between is cut alone as in its text.
        """
        data = TEXT_END.join([*texts, b""])
        joined, kinds = np.frombuffer(data, np.uint8), np.frombuffer(data.translate(KINDS), np.uint8)
        letter, ends, white, other = kinds == LETTER, kinds == END, kinds == SPACE, kinds == OTHER
        letter[1:] |= (joined[:-1] == 0xC3) & (kinds[1:] == LATIN)
        lead = white
        if (found := self.other_white.search(data)) is not None:
            white, lead = white.copy(), white.copy()
            for m in self.other_white.finditer(data, found.start()):
                white[m.start():m.end()] = lead[m.start()] = True
        first = ends.copy()
        first[:1] = True
        first[1:] |= ends[:-1] | letter[:-1] & other[1:] | white[1:] & ~white[:-1]
        behind = np.flatnonzero(white[:-1] & ~white[1:]) + 1
        behind = behind[~ends[behind]]
        leads = np.flatnonzero(lead)
        last = leads[np.searchsorted(leads, behind) - 1]
        first[last] = True
        first[behind[joined[last] != 32]] = True
        starts = np.flatnonzero(first)
        offsets = np.append(starts, len(joined)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
        coded = pieces.dictionary_encode()
        return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.flatnonzero(ends[starts]) + 1

    def cut(self, parts: list[str]) -> list[list[str]]:
        """The words of each part; parts without outer white space are cut in one go, with a break between them."""
        white = self.white
        joined = [p for p in parts if BREAK not in p and p[-1] not in white
                  and (p[0] not in white or p[0] == " " and p[1] not in white)]
        out = {}
        found = iter(self.find(BREAK.join(joined)))
        for p in joined:
            words = []
            for w in found:
                if w == BREAK:
                    break
                words.append(w)
            out[p] = words
        return [out[p] if p in out else self.find(p) for p in parts]

    def learn(self, new: list[bytes]) -> None:
        """Ids of pieces that are not known yet. A word is its own piece, so both share one table."""
        known = self.known
        rest = [p for p in new if ONE_WORD(p) is None and p != TEXT_END]
        cut = [[w.encode() for w in words] for words in self.cut([p.decode() for p in rest])]
        held = set(rest)
        words = list({*known.unknown(set().union(*cut)), *[p for p in new if p not in held and p != TEXT_END]})
        for w, (ids, plain) in zip(words, self.codec.encode(words)):
            if plain != w:
                raise ValueError(f"the ids of {w!r} decode to {plain!r}")
            known[w] = ids
        for p, ws in zip(rest, cut):
            known[p] = known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])

    def __call__(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        if not texts:
            return []
        try:
            b"\n".join(texts).decode()
        except UnicodeDecodeError:
            texts = [t.decode("utf-8", "replace").encode() for t in texts]
        distinct, places, ends = self.split(texts)
        known = self.known
        known.rest()
        known[TEXT_END] = b""
        ids = list(map(known.get, distinct))
        missing = [i for i, x in enumerate(ids) if x is None]
        self.learn(known.unknown([distinct[i] for i in missing]))
        for i in missing:
            ids[i] = known[distinct[i]]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        stream, until = gathered(np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes, sizes, places)
        stream, cuts = stream.tobytes(), (4 * until[ends]).tolist()
        encoded = [stream[a:b] for a, b in zip([0, *cuts], cuts)]
        return list(zip(encoded, self.codec.decode(encoded)))


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, fields: str, derive) -> DataFrame:
    """doc_id and what ``derive(ids, decoded)`` gives for each whole text, as the columns in ``fields``.

    ids are the bytes of little-endian unsigned 32-bit integers. The rank file is read on the driver and broadcast; its
    size is that of a vocabulary below 65,536 tokens, whatever the documents.
    """
    spark: SparkSession = docs.sparkSession
    ranks = read_ranks(rank_file)
    shared = spark.sparkContext.broadcast((ranks, merge_table(ranks)))

    def start():
        codec = kept_in_worker(("byte_bpe", rank_file, pattern), lambda: TextCodec(Codec(*shared.value), pattern))
        return lambda texts: list(zip(*[derive(*pair) for pair in codec(texts)]))

    return per_text(docs, fields, start, limit=SLAB)


def encode_ids(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and its token ids."""
    return encode_documents(docs, rank_file, pattern, "ids array<int>",
                            lambda ids, plain: (np.frombuffer(ids, dtype="<i4"),))


def encode_digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the bytes they decode to."""
    return encode_documents(docs, rank_file, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                            lambda ids, plain: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(plain).hexdigest()))
