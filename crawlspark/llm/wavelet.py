"""Token ids in wavelet matrices: compressed files with access, rank and select.

A file holds the ids of consecutive documents as bit-planes, highest bit first; each plane is the last one's order,
stably parted by its bit. Ranks come from counts per 512 bits, selects from a search in them. Token access walks the
planes down, counting an id narrows a range, and an occurrence is mapped back up by select.

The tokenizer is the library's: its normalizer's and pre-tokenizer's results do not depend on text beyond white space,
so each distinct piece between ASCII white space is normalized and cut once, and each distinct word goes through the
library's model once. Text that holds an added token of the tokenizer is encoded whole.

Defined cases: a null or empty text has only the end id; equal doc_ids stay as rows of their own, ordered by the
number and a hash of their ids; rows without doc_id come first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import Remembered, gathered, kept_in_worker, per_text

MAGIC, PLANES, BLOCK_BITS = b"WVM1", 16, 512
FILE_TOKENS = 1 << 18    # a file closes at the first document that reaches it
KEPT_WORDS = 1_200_000
END_ID = 2

# Fixed by the byte-level vocabulary: printable Latin-1 stands for itself, other bytes for letters from U+0100 on. A
# space stays, as it parts the words.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = dict(zip([b for b in range(256) if b not in _PRINTED], range(256, 512)))
del BYTE_LETTERS[32]
WHITE = b" \t\n\x0b\x0c\r"
# Kinds of bytes, in lower case: letters and digits, the second byte of a letter from U+00C0 to U+00FF, white space, other ASCII.
PLAIN, LATIN, SPACE, OTHER = 1, 2, 3, 4
KINDS = bytes([PLAIN if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else SPACE if b in WHITE else OTHER if b < 0x80
               else LATIN if b < 0xC0 and b not in (0x97, 0xB7) else 0 for b in range(256)])
# Letters up to U+024F whose lower case is one letter: one word.
ONE_WORD = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc5-\xc8][\x80-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]"
                      rb"|\xc9[\x80-\x8f])+").fullmatch


class WordEncoder:
    """Texts to ids (little-endian unsigned 16-bit) with the tokenizer's own model, each distinct piece and word once.

    A piece of Latin script is already in normal form; it is lower-cased and cut by the tokenizer's pattern here, many
    pieces in one go, and its words go to the model. Any other piece, and any text with an added token, is encoded by
    the tokenizer as it is.
    """

    def __init__(self, definition: str, kept: int = KEPT_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_str(definition)
        vocabulary = self.whole.get_vocab()
        if max(vocabulary.values()) >= 1 << PLANES:
            raise ValueError(f"ids must fit in {PLANES} bits")
        spec = json.loads(definition)
        suffix = spec["model"]["end_of_word_suffix"]
        self.last = np.zeros(1 << PLANES, dtype=bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.model_only = Tokenizer(self.whole.model)
        self.model_only.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern + r"|\n").findall
        self.latin = re.compile("[!-~\u00a1-\u024f]*").fullmatch
        self.added = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.pieces = Remembered(kept)

    @staticmethod
    def _split(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct pieces between white space, in lower case, every piece of the texts as a place among them, and
        how many pieces end with each text. What follows a letter or digit and is neither starts a piece of its own.

        Neither changes where words are cut, and pieces repeat more often so.
        """
        data = b"\n".join([*texts, b""]).lower()
        joined, kinds = np.frombuffer(data, np.uint8), np.frombuffer(data.translate(KINDS), np.uint8)
        filled = kinds != SPACE
        first = filled.copy()
        first[1:] &= ~filled[:-1]
        others = np.flatnonzero(kinds == OTHER)
        before = kinds[others - 1]
        first[others[(before == PLAIN) | (before == LATIN) & (joined[others - 2] == 0xC3)]] = True
        starts = np.flatnonzero(first)
        sizes = np.flatnonzero(filled[:-1] & (first | ~filled)[1:]) + 1 - starts
        offsets, letters = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), data.translate(None, WHITE)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        coded = pieces.dictionary_encode()
        ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), ends

    def _encode_whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Each word through the library's model; many words meet in a call and part at the ids that end a word."""
        out = []
        for i in range(0, len(words), 2048):
            some = words[i:i + 2048]
            line = " ".join(some)
            if not (line.isascii() and line.isprintable()):  # letters of the vocabulary otherwise
                line = line.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = np.array(self.model_only.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype="<u2")
            ends = [0, *(2 * (np.flatnonzero(self.last[ids]) + 1)).tolist()]
            if len(ends) != len(some) + 1 or ends[-1] != 2 * len(ids):
                out += [self._encode_whole(w) for w in some]
                continue
            stream = ids.tobytes()
            out += [stream[a:b] for a, b in zip(ends, ends[1:])]
        return out

    def _learn(self, new: list[bytes]) -> None:
        """Ids of pieces that are not known yet. A word is its own piece, so both share one table."""
        known = self.pieces
        letters = [p for p in new if p.isalpha()]  # ASCII letters: one word
        known.update(zip(letters, self._encode_words([p.decode() for p in letters])))
        rest = [p for p in new if p not in known]
        latin = [p for p in rest if ONE_WORD(p)]  # one word as well, but for its case
        lowered = b"\n".join(latin).decode().lower().encode().split(b"\n") if latin else []
        fresh = list(known.unknown(set(lowered)))
        known.update(zip(fresh, self._encode_words([w.decode() for w in fresh])))
        known.update(zip(latin, [known[w] for w in lowered]))
        held = set(latin)
        rest = [p for p in rest if p not in held]
        try:
            strings = b"\n".join(rest).decode().split("\n")
        except UnicodeDecodeError:
            strings = [p.decode("utf-8", "replace") for p in rest]
        plain, held, cut = [], [], []
        for piece, string in zip(rest, strings):
            if string.isascii() and string.isprintable() or self.latin(string):
                plain.append(piece)
                held.append(string)
            else:
                known[piece] = self._encode_whole(string)
        found = iter(self.find("\n".join(held).lower()))
        for _ in plain:
            words = []
            for w in found:
                if w == "\n":
                    break
                words.append(w.encode())
            cut.append(words)
        fresh = known.unknown(set().union(*cut))
        known.update(zip(fresh, self._encode_words([w.decode() for w in fresh])))
        known.update(zip(plain, [known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws]) for ws in cut]))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if not texts:
            return []
        special = [any(a in t for a in self.added) for t in texts]
        distinct, places, ends = self._split([b"" if s else t for t, s in zip(texts, special)])
        known = self.pieces
        known.rest()
        ids = list(map(known.get, distinct))
        missing = [i for i, x in enumerate(ids) if x is None]
        self._learn(known.unknown([distinct[i] for i in missing]))
        for i in missing:
            ids[i] = known[distinct[i]]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 2
        stream, until = gathered(np.frombuffer(b"".join(ids), "<u2"), np.cumsum(sizes) - sizes, sizes, places)
        stream, cuts = stream.tobytes(), (2 * until[ends]).tolist()
        return [self._encode_whole(t.decode("utf-8", "replace")) if s else stream[a:b]
                for t, s, a, b in zip(texts, special, [0, *cuts], cuts)]


def rank_counts(packed: np.ndarray) -> np.ndarray:
    """Ones before each block of 512 bits."""
    words = np.concatenate((packed, np.zeros(-len(packed) % (BLOCK_BITS // 8), np.uint8))).view(np.uint64)
    ones = np.bitwise_count(words).reshape(-1, BLOCK_BITS // 64).sum(axis=1, dtype=np.int64)
    return np.concatenate(([0], np.cumsum(ones))).astype("<u4")


class WaveletMatrix:
    def __init__(self, n: int, planes: list[bytes], counts: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.counts, self.zeros = n, planes, counts, zeros

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        planes, counts, zeros, row = [], [], [], ids.astype(np.uint16)
        for level in range(PLANES):
            one = (row & np.uint16(1 << (PLANES - 1 - level))) != 0
            row = np.concatenate((np.compress(~one, row), np.compress(one, row)))
            packed = np.packbits(one)
            planes.append(packed.tobytes())
            counts.append(rank_counts(packed))
            zeros.append(len(one) - int(counts[-1][-1]))
        return cls(len(ids), planes, counts, zeros)

    def to_bytes(self) -> bytes:
        """Magic, count of ids, zeros of each plane, then the planes and rank counts, compressed."""
        body = b"".join([*self.planes, *[c.tobytes() for c in self.counts]])
        return MAGIC + struct.pack(f"<Q{PLANES}Q", self.n, *self.zeros) + zstandard.ZstdCompressor(level=1).compress(body)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, *zeros = struct.unpack_from(f"<Q{PLANES}Q", data, 4)
        body = zstandard.ZstdDecompressor().decompress(data[4 + 8 * (PLANES + 1):])
        size, blocks = -(-n // 8), -(-n // BLOCK_BITS) + 1
        planes = [body[k * size:(k + 1) * size] for k in range(PLANES)]
        base = PLANES * size
        counts = [np.frombuffer(body, "<u4", blocks, base + 4 * blocks * k) for k in range(PLANES)]
        return cls(n, planes, counts, list(zeros))

    def bit(self, level: int, i: int) -> int:
        return self.planes[level][i >> 3] >> (7 - (i & 7)) & 1

    def ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK_BITS
        first = block * BLOCK_BITS // 8
        part = int.from_bytes(self.planes[level][first:(i + 7) // 8], "big") >> (-i % 8)
        return int(self.counts[level][block]) + part.bit_count()

    def select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self.ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(PLANES):
            b, ones = self.bit(level, i), self.ones(level, i)
            value, i = value << 1 | b, self.zeros[level] + ones if b else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(PLANES):
            a, b = self.ones(level, lo), self.ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (PLANES - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id at places lo to hi (exclusive)."""
        lo, hi = self._range(token, lo, self.n if hi is None else hi)
        return hi - lo

    def locate(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id; -1 if there is none."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            return -1
        i = lo + k
        for level in reversed(range(PLANES)):
            b = token >> (PLANES - 1 - level) & 1
            i = self.select(level, b, i - self.zeros[level] if b else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids: the planes undone from the last to the first."""
        row = np.zeros(self.n, dtype=np.uint16)
        for level in reversed(range(PLANES)):
            bits = np.unpackbits(np.frombuffer(self.planes[level], np.uint8), count=self.n).view(bool)
            up, z = np.empty_like(row), self.zeros[level]
            up[np.flatnonzero(~bits)] = row[:z]
            up[np.flatnonzero(bits)] = row[z:] | np.uint16(1 << (PLANES - 1 - level))
            row = up
        return row


def write_files(docs: DataFrame, definition: str, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> str:
    """Encodes, orders by doc_id and writes the files; returns their place.

    Each row of the written table is a file: ``part`` (range of doc_ids), ``seq`` (order in it), ``doc_ids``, ``ends``
    (ids up to each document's end, within the file) and ``file``, the compressed wavelet matrix.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(definition)  # the size of a vocabulary below 65,536 words
    end = int(end_id).to_bytes(2, "little")

    def start():
        encoder = kept_in_worker(("words", hash(shared.value)), lambda: WordEncoder(shared.value))
        return lambda texts: [[x + end for x in encoder(texts)]]

    home = shared_dir(spark, "tokens")
    # Range partitioning reads its input twice, so the ids are written first.
    per_text(docs, "ids binary", start).write.parquet(f"{home}/encoded")
    rows = spark.read.parquet(f"{home}/encoded")
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(count, "doc_id").withColumn("part", F.spark_partition_id())
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.length("ids"), F.xxhash64("ids"))
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                        ("ends", pa.list_(pa.int64())), ("file", pa.binary())])

    def build(batches):
        ids, held, total, seq, part = [], [], 0, 0, 0

        def made():
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(held), "<u2"))
            ends = np.cumsum([len(x) // 2 for x in held])
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()),
                                               pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())),
                                               pa.array([matrix.to_bytes()], pa.binary())], schema=schema)

        for batch in batches:
            for doc_id, data, part in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                ids.append(doc_id)
                held.append(data)
                total += len(data) // 2
                if total >= file_tokens:
                    yield made()
                    ids, held, total, seq = [], [], 0, seq + 1
        if held:
            yield made()

    ordered.select("doc_id", "ids", "part").mapInArrow(
        build, "part int, seq int, doc_ids array<long>, ends array<long>, file binary").write.parquet(f"{home}/files")
    return f"{home}/files"


def read_files(spark, place: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.parquet(place)
    sizes = files.select("part", "seq", F.coalesce(F.element_at("ends", -1), F.lit(0)).alias("n"))
    # Two levels of sums: the parts are as many as the shuffle partitions, the files of a part follow one another.
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS part_start")
    within = sizes.selectExpr("part", "seq", "sum(n) OVER (PARTITION BY part ORDER BY seq) - n AS file_start")
    starts = within.join(before, "part").selectExpr("part", "seq", "part_start + file_start AS start")

    def read(batches):
        for batch in batches:
            for start, doc_ids, ends, data in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                stream = WaveletMatrix.from_bytes(data).tokens().astype("<u4").tobytes()
                cuts = [0, *ends]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array([start + a for a in cuts[:-1]], pa.int64()),
                    "n_tokens": pa.array([b - a for a, b in zip(cuts, cuts[1:])], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(stream[4 * a:4 * b]) for a, b in zip(cuts, cuts[1:])], pa.int64())})

    return (files.join(starts, ["part", "seq"]).select("start", "doc_ids", "ends", "file")
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_index(docs: DataFrame, definition: str, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    return read_files(docs.sparkSession, write_files(docs, definition, end_id, file_tokens))
