"""Ranked lexical search with norm buckets: for every item the documents of the highest exact scores.

A document is its impact vector: for each term of the items it holds, the term's weight times the term's saturated
frequency. A score is the inner product of that vector with the item's term counts, so finding the best documents is a
maximum inner product search:

* the vectors of a slab are ordered by length and cut into buckets of ``BUCKET`` documents, longest first;
* the length of the item's vector times the longest of a bucket bounds every score in it (Cauchy-Schwarz); where that is
  below the score that the item already needs, this bucket and all shorter ones are left out;
* inside a bucket the largest value of each coordinate gives a second bound: coordinates that cannot reach the needed
  score together are no focus, and only documents with a focus coordinate are looked at. What they have in focus is
  added up; for the rest counts the smaller of the coordinates' bounds and the length that is left over;
* survivors are scored again in 64-bit integers. Bounds are rounded up, so no document is lost.

Spark: one map over the whole texts writes each document's term counts, restricted to the terms of a block of items; sums
over that table give the collection's figures. A first round searches the longest bucket of every slab; its ``TOP``-th
best score is what each item needs from the start of the second round, which searches all buckets. Each slab brings at
most ``TOP`` documents an item to the final ranking. Items come to the tasks in blocks of bounded size, in turn.

Defined cases: a null or empty text has no term and is never found; an item without terms finds nothing; rows of items
that share an item_id are one item with the terms of all; repeated documents and equal doc_ids are rows of their own, null
doc_ids come first among ties; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import per_text

TOP = 20
BUCKET = 1024                # documents
SLAB_TERMS = 1 << 21         # term counts that are searched together
BLOCK_CHARS = 4 << 20        # characters of items that go to the tasks at once
SLACK = 1 + 1e-9             # bounds are rounded up by this factor
NO_ID = -(1 << 63)           # stands for a null doc_id while documents are sorted
# Terms are digits, letters and everything beyond ASCII; only A-Z is lower-cased.
TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def item_blocks(items: DataFrame, limit: int = BLOCK_CHARS):
    """Items in blocks of about ``limit`` characters, one after the other: {item_id: counts of its terms}."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    count = -(-size // limit)
    for k in range(count):
        part = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k) if count > 1 else rows
        block: dict = {}
        for r in part.collect():
            block.setdefault(r.item_id, Counter()).update(terms_of(r.text.encode()))
        yield {i: c for i, c in block.items() if c}


def term_counts(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (all terms of the text) and, for the given terms that the text holds, ``term`` (number) and ``tf``."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def start():
        numbers = {t: k for k, t in enumerate(shared.value)}

        def count(texts):
            sizes, ids, tfs = [], [], []
            for text in texts:
                words = terms_of(text)
                found = {numbers[t]: n for t, n in Counter(words).items() if t in numbers}
                sizes.append(len(words))
                ids.append(np.fromiter(found.keys(), np.int32, len(found)))
                tfs.append(np.fromiter(found.values(), np.int32, len(found)))
            return [sizes, ids, tfs]

        return count

    return per_text(docs, "n long, term array<int>, tf array<int>", start)


def document_frequencies(counts: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of the ``size`` terms; every task sends one row for each term it saw."""
    schema = pa.schema([("term", pa.int32()), ("df", pa.int64())])

    def count(batches):
        seen = np.zeros(size, dtype=np.int64)
        for batch in batches:
            seen += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(seen[some])], schema=schema)

    out = np.zeros(size, dtype=np.int64)
    found = counts.select("term").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in found.collect():  # as many rows as the block has terms
        out[r.term] = r.df
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Search:
    """The items of a block and the best documents that each has found so far."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int,
                 needed: np.ndarray, top: int = TOP, bucket: int = BUCKET):
        self.items, self.weight, self.n_docs, self.n_terms = items, weight, n_docs, n_terms
        self.top, self.bucket = top, bucket
        self.needed = needed.astype(np.float64)  # a document below this score is not among the best
        self.norms = np.array([math.sqrt(float((q * q).sum())) for _, q in items])
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items]
        self.count = np.zeros(len(weight), dtype=np.int64)   # an item's counts, while it is searched
        self.group = np.full(len(weight), -1)                # a term's place among the terms of a bucket

    def vectors(self, doc_ids, n, sizes, term, tf):
        """The documents in the order of their vectors' lengths, longest first."""
        m = 100 - 25 + (25 * n * self.n_docs) // self.n_terms
        value = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, sizes)))
        starts = np.cumsum(sizes) - sizes
        squares = np.add.reduceat(value.astype(np.float64) ** 2, starts)
        order = np.argsort(-squares, kind="stable")
        at = spans(starts[order], sizes[order])
        return doc_ids[order], sizes[order], term[at], value[at], squares[order]

    def add(self, doc_ids, n, sizes, term, tf, only_longest: bool) -> None:
        """Searches one slab: documents with their sizes, and the term counts of all in one row."""
        some = sizes > 0
        if not some.any():
            return
        doc_ids, sizes, term, value, squares = self.vectors(doc_ids[some], n[some], sizes[some], term, tf)
        ends = np.cumsum(sizes)
        active = np.ones(len(self.items), dtype=bool)
        for lo in range(0, self.bucket if only_longest else len(sizes), self.bucket):
            hi = min(lo + self.bucket, len(sizes))
            active &= self.norms * math.sqrt(squares[lo]) * SLACK >= self.needed
            if not active.any():
                break
            a, b = ends[lo] - sizes[lo], ends[hi - 1]
            self.search_bucket(np.flatnonzero(active), doc_ids[lo:hi], sizes[lo:hi], term[a:b], value[a:b], squares[lo:hi])

    def search_bucket(self, chosen, doc_ids, sizes, term, value, squares) -> None:
        row_starts = np.cumsum(sizes) - sizes
        by_term = np.argsort(term, kind="stable")
        sorted_terms = term[by_term]
        first = np.concatenate(([0], np.flatnonzero(np.diff(sorted_terms)) + 1))
        held, lengths = sorted_terms[first], np.diff(np.append(first, len(term)))
        row = np.repeat(np.arange(len(sizes)), sizes)[by_term]
        coordinate = value[by_term].astype(np.float64)
        largest = np.maximum.reduceat(coordinate, first)
        self.group[held] = np.arange(len(held))
        for k in chosen.tolist():
            ids, q = self.items[k]
            groups = self.group[ids]
            groups, q_held = groups[groups >= 0], q[groups >= 0]
            bound = q_held * largest[groups]
            needed = self.needed[k]
            if not len(bound) or bound.sum() * SLACK < needed:
                continue
            # Coordinates that cannot reach the needed score together are the rest, the others the focus.
            order = np.argsort(bound, kind="stable")
            reach = np.cumsum(bound[order])
            cut = int(np.searchsorted(reach * SLACK, needed, side="left")) if needed > 0 else 0
            focus, rest = order[cut:], order[:cut]
            at = spans(first[groups[focus]], lengths[groups[focus]])
            part = coordinate[at]
            sums = np.bincount(row[at], np.repeat(q_held[focus], lengths[groups[focus]]) * part, len(sizes))
            found = np.flatnonzero(sums)
            if cut:
                left = np.sqrt(np.maximum(squares - np.bincount(row[at], part * part, len(sizes)) / SLACK, 0))[found]
                more = np.minimum(reach[cut - 1], math.sqrt(float((q_held[rest] ** 2).sum())) * left)
                found = found[(sums[found] + more) * SLACK >= needed]
            if len(found):
                self.count[ids] = q
                at = spans(row_starts[found], sizes[found])
                starts = np.cumsum(sizes[found]) - sizes[found]
                self.keep(k, np.add.reduceat(self.count[term[at]] * value[at], starts), doc_ids[found])
                self.count[ids] = 0
        self.group[held] = -1

    def keep(self, k: int, scores: np.ndarray, doc_ids: np.ndarray) -> None:
        some = (scores > 0) & (scores >= self.needed[k])
        scores = np.concatenate((self.best[k][0], scores[some]))
        doc_ids = np.concatenate((self.best[k][1], doc_ids[some]))
        order = np.lexsort((doc_ids, -scores))[: self.top]
        self.best[k] = scores[order], doc_ids[order]
        if len(order) == self.top:
            self.needed[k] = max(self.needed[k], float(scores[order[-1]]))


def search_round(counts: DataFrame, items, weight, n_docs: int, n_terms: int, needed, only_longest: bool, top: int) -> DataFrame:
    """item (number), doc_id, score: at most ``top`` documents an item from every task, all of the best among them."""
    shared = counts.sparkSession.sparkContext.broadcast((items, weight, needed))  # bounded by the block of items
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(batches):
        items, weight, needed = shared.value
        best, held, size = Search(items, weight, n_docs, n_terms, needed, top), [], 0

        def slab():
            columns = pa.Table.from_batches(held).combine_chunks()
            term, tf = (columns[c].combine_chunks() for c in ("term", "tf"))
            best.add(columns["doc_id"].fill_null(NO_ID).to_numpy(), columns["n"].to_numpy(),
                     term.value_lengths().to_numpy().astype(np.int64), term.flatten().to_numpy(),
                     tf.flatten().to_numpy().astype(np.int64), only_longest)

        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= SLAB_TERMS:
                slab()
                held, size = [], 0
        if size:
            slab()
        for k, (scores, doc_ids) in enumerate(best.best):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), k), pa.int32()),
                                                  pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(scores)], schema=schema)

    return counts.select("doc_id", "n", "term", "tf").mapInArrow(search, "item int, doc_id long, score long")


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search_block(docs: DataFrame, block: dict, top: int) -> DataFrame:
    """The ranking of one block of items."""
    spark = docs.sparkSession
    home = shared_dir(spark, "search")
    terms = sorted(set().union(*block.values()))
    term_counts(docs, terms).write.parquet(f"{home}/counts")
    counts = spark.read.parquet(f"{home}/counts")
    total = counts.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    weight = weights(document_frequencies(counts, len(terms)), total.docs)
    numbers = {t: k for k, t in enumerate(terms)}
    items = [(np.array([numbers[t] for t in c]), np.array(list(c.values()), dtype=np.int64)) for c in block.values()]
    figures = (items, weight, total.docs, total.terms or 1)
    needed = np.zeros(len(items))
    first = ranked(search_round(counts, *figures, needed, True, top), top).filter(F.col("rank") == top)
    for r in first.select("item", "score").collect():  # one row an item
        needed[r.item] = r.score
    best = ranked(search_round(counts, *figures, needed, False, top), top)
    names = spark.createDataFrame(list(enumerate(block)), "item int, item_id long")  # the items of one block
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def best_documents(docs: DataFrame, items: DataFrame, top: int = TOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item, highest score first, ties by doc_id."""
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in item_blocks(items, block_chars):
        if block:
            out = out.unionByName(search_block(docs, block, top))
    return out
