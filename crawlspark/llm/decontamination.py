"""Benchmark decontamination: which test items stand, nearly whole, in which documents.

Containment is the share of an item's distinct five-word shingles that occur anywhere in the document. Items are parted
by size: a part holds the items of ``low`` to ``2 * low - 1`` shingles, with a MinHash index of its own in which each item
is represented by its k smallest shingle hashes. k belongs to the part; it is one more than the shingles that its largest
item may lack, so a document which contains an item holds at least one of its minima, and at least k less what the item
may lack: the search loses nothing. A part is asked only by documents with the shingles its smallest items need. What
is found is verified by exact containment of the shingles themselves.

Documents are long and many, items short: documents are read once and never shuffled. Items go to the documents in
blocks of a bounded number of shingles, a pass over the documents for each block.

Words are runs of bytes other than ASCII characters that are neither letters nor digits, with A-Z in lower case; a
text of fewer than five words is one shingle, so an item of fewer than five is found only in a text of as many words; such
items are parts of their own, by their number of words. Defined cases: null or empty items match nothing, null or empty
documents hold nothing; equal ids stay as rows of their own (pairs repeat); empty tables give an empty result; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_texts, slabs, texts_of

WIDTH, SHARE = 5, 0.8
BLOCK_SHINGLES = 400_000
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def shingles_of(words: list[bytes], width: int = WIDTH) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def needed(n: int, share: float = SHARE) -> int:
    """The fewest of n shingles that make up the share."""
    return max(1, -(-int(round(share * 1000)) * n // 1000))


def minima_count(n: int, share: float = SHARE) -> int:
    return n - needed(n, share) + 1


class SizePart:
    """The MinHash index of the items with ``low`` to ``2 * low - 1`` shingles of ``width`` words."""

    def __init__(self, width: int, low: int, signatures: list[tuple[int, list[int]]], share: float):
        self.width, self.least = width, needed(low, share)
        k = minima_count(2 * low - 1, share)
        rows = sorted((h, number) for number, hashes in signatures for h in hashes[:k])
        self.hashes = np.array([h for h, _ in rows], dtype=np.uint64)
        self.items_at = np.array([i for _, i in rows], dtype=np.int64)
        self.least_hits = {number: max(1, min(k, len(hashes)) - (len(hashes) - needed(len(hashes), share)))
                           for number, hashes in signatures}

    def candidates(self, hit: np.ndarray) -> list[int]:
        """Items of which enough minima are among the distinct hashes ``hit``."""
        first, last = np.searchsorted(self.hashes, hit), np.searchsorted(self.hashes, hit, side="right")
        numbers = np.concatenate([self.items_at[a:b] for a, b in zip(first, last)] or [self.items_at[:0]])
        items, hits = np.unique(numbers, return_counts=True)
        return [i for i, n in zip(items.tolist(), hits.tolist()) if n >= self.least_hits[i]]


class ItemBlock:
    """A block of items, ready to be searched for in texts."""

    def __init__(self, items: list[tuple[int, bytes]], width: int = WIDTH, share: float = SHARE):
        self.width, self.share = width, share
        self.ids, self.shingles, widths = [], [], []
        for item_id, text in items:
            words = words_of(text)
            if words:
                self.ids.append(item_id)
                self.shingles.append(shingles_of(words, width))
                widths.append(min(width, len(words)))
        vocabulary: dict[bytes, int] = {}
        for found in self.shingles:
            for s in found:
                for w in s.split():
                    vocabulary.setdefault(w, len(vocabulary))
        self.vocabulary = vocabulary
        self.keys = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary] or [0], dtype=np.uint64)
        sized: dict[tuple[int, int], list] = {}
        for number, (words, found) in enumerate(zip(widths, self.shingles)):
            low = 1 << (len(found).bit_length() - 1)
            sized.setdefault((words, low), []).append((number, sorted(self.hash_shingle(s) for s in found)))
        self.parts = [SizePart(words, low, rows, share) for (words, low), rows in sorted(sized.items())]
        # All parts' minima, for one look at each shingle of a text.
        self.hashes = np.unique(np.concatenate([p.hashes for p in self.parts] or [np.empty(0, np.uint64)]))

    def hash_shingle(self, shingle: bytes) -> int:
        h = 0
        for w in shingle.split():
            h = (h * int(STEP) + int(self.keys[self.vocabulary[w]])) & 0xFFFFFFFFFFFFFFFF
        return h

    def search(self, text: bytes) -> list[tuple[int, int, int]]:
        """Number of the item, its shingles, and those found, for each item that the text contains."""
        words = words_of(text)
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        known = ids >= 0
        width = min(self.width, len(words))
        if not known.any():
            return []
        # Shingles of known words only; the others can't be an item's.
        n = len(words) - width + 1
        run = np.concatenate(([0], np.cumsum(known)))
        at = np.flatnonzero(run[width:] - run[:n] == width)
        hashes = self.shingle_hashes(ids, at, width)
        place = np.searchsorted(self.hashes, hashes)
        place[place == len(self.hashes)] = 0
        hit = np.unique(hashes[self.hashes[place] == hashes]) if len(self.hashes) else hashes[:0]
        if not len(hit):
            return []
        out, held = [], None
        for i in sorted(i for part in self.parts if part.width == width and part.least <= len(at) for i in part.candidates(hit)):
            if held is None:
                held = {b" ".join(words[a:a + width]) for a in at.tolist()}
            wanted = self.shingles[i]
            found = len(wanted & held)
            if found >= needed(len(wanted), self.share):
                out.append((i, len(wanted), found))
        return out

    def shingle_hashes(self, ids: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(width):
            h = h * STEP + self.keys[ids[at + k]]
        return h


def item_blocks(items: DataFrame, limit: int = BLOCK_SHINGLES):
    """The items in blocks of about ``limit`` words; each block alone is brought to the driver and broadcast."""
    items = items.select(F.col("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    words = items.agg(F.sum(F.size(F.split("text", "\\s+"))).alias("n")).first().n or 0
    count = -(-words // limit)
    for k in range(count):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) if count > 1 else items
        yield [(r.item_id, r.text.encode()) for r in part.orderBy("item_id", "text").collect()]


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment for each document that holds the share of an item."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_found", pa.int64())])
    ddl = "doc_id long, item_id long, n_shingles long, n_found long"
    out = spark.createDataFrame([], ddl)
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def search(batches, shared=shared):
            index = ItemBlock(shared.value, width, share)
            for batch in batches:
                ids, column, found = batch.column(0).to_pylist(), batch.column(1), []
                for lo, hi in slabs(column):
                    for doc_id, text in zip(ids[lo:hi], texts_of(column.slice(lo, hi - lo))):
                        found += [(doc_id, index.ids[i], n, k) for i, n, k in index.search(text)]
                columns = list(zip(*found)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        out = out.unionByName(rows.mapInArrow(search, ddl))
    return out.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def clean_of(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """The documents that hold no item, all columns as they are."""
    for block in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def start(shared=shared):
            index = ItemBlock(shared.value, width, share)
            return lambda texts: [not index.search(t) for t in texts]

        docs = keep_texts(docs, start)
    return docs
