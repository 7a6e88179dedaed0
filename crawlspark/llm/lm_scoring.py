"""Masked pseudo-likelihood by a bidirectional window network trained in numpy.

Every token is predicted from the two tokens before and the two after it: their embeddings, weighted for each place,
are added, pass a tanh layer and predict first a class of rows and then the row in its class, so that probabilities
are exact and cheap. A document's score is the sum of the conditional log-probabilities of its tokens.

Vocabulary: the most frequent words of the whole corpus have a row each; every other word shares one of ``HASHED`` rows
(buckets), and its probability is that of the bucket times count(word) / count(bucket) over all documents, so the
probabilities of all words of the corpus sum to one. At most ``KNOWN`` words bring their shares to the scoring map; the
rare rest gets its counts by a join with the table of all word counts.

Training goes once over every position of all documents: in each of ``ROUNDS`` rounds every partition trains its own
copy from the common start, on every ``ROUNDS``-th of its documents (others each round), and sends its weights; Spark
sums them, weighted by tokens, in whole numbers, so that the order of arrival does not matter. The driver holds one
network, whose size is fixed by the parameters.

Defined cases: a null or empty text has no token, sum 0 and mean null; places before and after a text are a mark of
their own; repeated rows and equal doc_ids stay as rows; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import per_text, slabs, texts_of

FREQUENT, HASHED, DIM, REACH = 768, 255, 16, 2
ROUNDS, RATE, BATCH, SEED = 2, 3.0, 1024, 5
ROWS = 1024                      # FREQUENT words, HASHED buckets and the mark of an end
KNOWN = 1 << 17                  # words whose shares of their buckets are broadcast
CLASSES = 32
IN_CLASS = ROWS // CLASSES
EDGE = ROWS - 1
SMALL = np.int16                 # rows fit, and 16-bit numbers are sorted by radix
STEPS = 1 << 24                  # weights are summed as whole multiples of 1 / STEPS
LOG_STEPS = 1 << 28              # and logarithms of counts as those of 1 / LOG_STEPS
OFFSETS = [k for k in range(-REACH, REACH + 1) if k]


class Vocabulary:
    """Word -> id. Ids of a class are next to each other; words are dealt to the classes by frequency rank."""

    def __init__(self, frequent: list[bytes]):
        self.ids = {w: (k % CLASSES) * IN_CLASS + k // CLASSES for k, w in enumerate(frequent)}
        taken = set(self.ids.values()) | {EDGE}
        self.rest = np.array([i for i in range(ROWS) if i not in taken])


    def __call__(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        other = out < 0
        out[other] = self.rest[np.fromiter(map(zlib.crc32, compress(words, other.tolist())), np.int64) % len(self.rest)]
        return out


def padded(vocabulary, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts with marks around each, the places of the tokens, and the tokens of each text."""
    flat, sizes = split_words(texts)
    return *laid_out(vocabulary(flat), sizes), sizes


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts, one after the other, and their number in each text."""
    split = [t.lower().split() for t in texts]
    return [w for words in split for w in words], np.array([len(w) for w in split], dtype=np.int64)


def laid_out(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids with marks around each text, and the places of the tokens."""
    places = np.arange(len(ids)) + REACH + 2 * REACH * np.repeat(np.arange(len(sizes)), sizes)
    row = np.full(len(ids) + 2 * REACH * len(sizes), EDGE, dtype=np.int64)
    row[places] = ids
    return row, places


class Shares:
    """Rows of words and the logarithms of their shares of these rows, where the counts are at hand."""

    def __init__(self, vocabulary: Vocabulary, known: list[tuple[bytes, int]], buckets: np.ndarray):
        self.vocabulary = vocabulary
        known = [(w, 1) for w in vocabulary.ids] + [(w, n) for w, n in known if w not in vocabulary.ids]
        self.numbers = {w: k for k, (w, _) in enumerate(known)}
        self.rows = vocabulary([w for w, _ in known])
        self.log_buckets = np.log(np.maximum(buckets, 1))  # 0 for the rows of frequent words, which have no share
        self.shares = np.log(np.array([n for _, n in known], dtype=np.float64)) - self.log_buckets[self.rows]

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, log-shares (without log(count) for unknown words), and the numbers of the unknown words."""
        found = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(found < 0)
        rows, shares = (x[found] if len(x) else np.zeros(len(found), x.dtype) for x in (self.rows, self.shares))
        rows[unknown] = self.vocabulary([words[i] for i in unknown.tolist()])
        shares[unknown] = -self.log_buckets[rows[unknown]]
        return rows, shares, unknown


class Network:
    """Weights: embeddings, a weight vector for each place of the window, the layer's bias, classes and words."""

    SHAPES = {"embed": (ROWS, DIM), "place": (len(OFFSETS), DIM), "bias": (DIM,), "cls": (DIM, CLASSES),
              "cls_bias": (CLASSES,), "word": (CLASSES, DIM, IN_CLASS), "word_bias": (CLASSES, IN_CLASS)}

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def start(cls, unigrams: np.ndarray, seed: int = SEED):
        """Small random weights; the biases give the words' shares in the corpus."""
        rng = np.random.default_rng(seed)
        w = {k: rng.normal(0, 0.1, shape).astype(np.float32) for k, shape in cls.SHAPES.items()}
        w["place"][:] = 1
        w["bias"][:] = 0
        share = (unigrams + 0.5).reshape(CLASSES, IN_CLASS)
        w["cls_bias"] = np.log(share.sum(1) / share.sum()).astype(np.float32)
        w["word_bias"] = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
        return cls(w)

    @classmethod
    def from_vector(cls, v: np.ndarray):
        out, at = {}, 0
        for k, shape in cls.SHAPES.items():
            n = int(np.prod(shape))
            out[k] = v[at:at + n].reshape(shape).astype(np.float32)
            at += n
        return cls(out)

    def vector(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in self.SHAPES])

    def log_probabilities(self, row: np.ndarray, places: np.ndarray, batch: int = 1 << 14) -> np.ndarray:
        """log P(token | window) of every place."""
        out = np.empty(len(places), dtype=np.float64)
        tables = {k: self.w[k] for k in ("embed", "place")}
        mixed = [tables["embed"] * tables["place"][k] for k in range(len(OFFSETS))]
        for i in range(0, len(places), batch):
            at = places[i:i + batch]
            total = np.repeat(self.w["bias"][None, :], len(at), axis=0)
            for k, offset in enumerate(OFFSETS):
                total += mixed[k].take(row[at + offset], axis=0)
            h = np.tanh(total, out=total)
            target = row[at]
            group, inner = target // IN_CLASS, target % IN_CLASS
            z = h @ self.w["cls"] + self.w["cls_bias"]
            value = z[np.arange(len(at)), group] - log_sum(z)
            order = np.argsort(group, kind="stable")
            cuts = np.searchsorted(group[order], np.arange(CLASSES + 1))
            for c in range(CLASSES):
                some = order[cuts[c]:cuts[c + 1]]
                if len(some):
                    z = h[some] @ self.w["word"][c] + self.w["word_bias"][c]
                    value[some] += z[np.arange(len(some)), inner[some]] - log_sum(z)
            out[i:i + batch] = value
        return out

    def learn(self, row: np.ndarray, places: np.ndarray, rate: float = RATE, batch: int = BATCH) -> None:
        """One pass of mini-batch gradient descent over the places, in their order."""
        w, offsets, dims = self.w, np.array(OFFSETS)[:, None], np.arange(DIM, dtype=np.int32)
        row = row.astype(SMALL)  # a quarter of the memory that is read in no order
        for i in range(0, len(places), batch):
            # In the order of the rows, so that each class is a stretch, padded to the longest for one product.
            at = places[i:i + batch]
            at = at.take(np.argsort(row.take(at), kind="stable"))
            target = row.take(at).astype(np.int64)
            group, inner = target // IN_CLASS, target % IN_CLASS
            every, ones, step = np.arange(len(at)), np.ones(len(at), np.float32), rate / len(at)
            near = row.take(at + offsets)
            seen = w["embed"].take(near, axis=0)
            h = (seen * w["place"][:, None]).sum(axis=0)
            h += w["bias"]
            np.tanh(h, out=h)
            p = soft_max(h @ w["cls"] + w["cls_bias"])
            p[every, group] -= 1
            d_h = p @ w["cls"].T
            w["cls"] -= step * (h.T @ p)
            w["cls_bias"] -= step * (ones @ p)
            slot = every - np.searchsorted(group, np.arange(CLASSES))[group]
            width = int(slot.max()) + 1
            slot += group * width
            hs = np.zeros((CLASSES * width, DIM), dtype=np.float32)
            hs[slot] = h
            hs = hs.reshape(CLASSES, width, DIM)
            z = (hs @ w["word"] + w["word_bias"][:, None, :]).reshape(-1, IN_CLASS).take(slot, axis=0)
            some = soft_max(z)
            some[every, inner] -= 1
            p = np.zeros((CLASSES * width, IN_CLASS), dtype=np.float32)
            p[slot] = some
            p = p.reshape(CLASSES, width, IN_CLASS)
            d_h += (p @ w["word"].transpose(0, 2, 1)).reshape(-1, DIM).take(slot, axis=0)
            w["word"] -= step * (hs.transpose(0, 2, 1) @ p)
            w["word_bias"] -= step * (np.ones(width, np.float32) @ p)
            d = d_h * (1 - h * h)
            w["bias"] -= step * (ones @ d)
            seen *= d
            d_place = ones @ seen
            # All places of the window at once, equal words summed.
            cells = (near.reshape(-1, 1).astype(np.int32) * DIM + dims).ravel()
            moved = (d * (w["place"] * -step)[:, None]).ravel()
            w["embed"] += np.bincount(cells, moved, minlength=ROWS * DIM).reshape(ROWS, DIM).astype(np.float32)
            w["place"] -= step * d_place


def exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp(z - top), its row sums, and top: the largest of all values, or of each row where rows lie too far apart."""
    ones = np.ones(z.shape[1], dtype=z.dtype)
    top = z.max(keepdims=True)
    e = np.exp(z - top)
    sums = e @ ones
    if sums.min() < 1e-25:
        top = z.max(axis=1, keepdims=True)
        e = np.exp(z - top)
        sums = e @ ones
    return e, sums, top


def soft_max(z: np.ndarray) -> np.ndarray:
    e, sums, _ = exponentials(z)
    e /= sums[:, None]
    return e


def log_sum(z: np.ndarray) -> np.ndarray:
    _, sums, top = exponentials(z)
    return np.log(sums) + top[:, 0]


def word_counts(docs: DataFrame) -> DataFrame:
    """Counts of every word of every document: counted in each task, then summed by Spark."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches):
        for batch in batches:
            for lo, hi in slabs(batch.column(0), 16 << 20):
                seen: Counter[bytes] = Counter()
                for text in texts_of(batch.column(0).slice(lo, hi - lo)):
                    seen.update(text.lower().split())
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())],
                                                 schema=schema)

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Fitted:
    """The frequent words, the weights, the counts of the buckets' rows, the known words with counts, and all counts."""

    frequent: list[bytes]
    weights: np.ndarray
    buckets: np.ndarray
    known: list[tuple[bytes, int]]
    counts: DataFrame


def known_words(counts: DataFrame, limit: int) -> list[tuple[bytes, int]]:
    """The most frequent words, at most ``limit``; of those with the same count all or none.

    Where more than ``limit`` words are in the class of the largest counts, the first of it by count and word are taken.
    """
    top = 1 << 16  # counts from here on are taken together, so that the histogram is bounded
    held, least = 0, None
    for r in counts.groupBy(F.least("n", F.lit(top)).alias("n")).count().orderBy(F.desc("n")).collect():
        held += r["count"]
        if held > limit:
            break
        least = r.n
    if least is None:
        first = counts.filter(F.col("n") >= top).orderBy(F.desc("n"), "word").limit(limit) if held > limit else counts.limit(0)
        return [(bytes(r.word), r.n) for r in first.collect()]
    return [(bytes(r.word), r.n) for r in counts.filter(F.col("n") >= least).collect()]


def fit(docs: DataFrame, rounds: int = ROUNDS, known: int = KNOWN) -> Fitted:
    """The network trained on the documents, and the words' counts."""
    spark = docs.sparkSession
    home = shared_dir(spark, "lm")
    word_counts(docs).write.parquet(f"{home}/words")
    counts = spark.read.parquet(f"{home}/words")
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()  # FREQUENT rows
    frequent = [bytes(r.word) for r in top]
    vocabulary = Vocabulary(frequent)
    # The same hash as the vocabulary's; the frequent words are taken out of their buckets again.
    rest = vocabulary.rest
    buckets = np.zeros(ROWS)
    for r in counts.groupBy((F.crc32("word") % len(rest)).alias("k")).agg(F.sum("n").alias("n")).collect():
        buckets[rest[r.k]] = r.n
    unigrams = np.zeros(ROWS)
    for r in top:
        unigrams[vocabulary.ids[bytes(r.word)]] = r.n
        buckets[rest[zlib.crc32(bytes(r.word)) % len(rest)]] -= r.n
    unigrams += buckets
    weights = Network.start(unigrams).vector()
    schema = pa.schema([("place", pa.int32()), ("step", pa.int64()), ("tokens", pa.int64())])
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((frequent, weights))

        def train(batches, shared=shared, turn=turn):
            words, start = shared.value
            lookup, network, tokens, before = Vocabulary(words), Network.from_vector(start.copy()), 0, 0
            for batch in batches:
                for lo, hi in slabs(batch.column(0)):
                    texts = texts_of(batch.column(0).slice(lo, hi - lo))
                    row, places, _ = padded(lookup, texts[(turn - before) % rounds::rounds])
                    before += len(texts)
                    # An order apart from that of the texts, the same in every attempt of the task.
                    network.learn(row, np.random.default_rng(SEED + turn).permutation(places))
                    tokens += len(places)
            if tokens:
                moved = np.rint((network.vector().astype(np.float64) - start) * STEPS).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(moved)), pa.int32()), pa.array(moved * (tokens // 1000 + 1)),
                     pa.array(np.full(len(moved), tokens // 1000 + 1), pa.int64())], schema=schema)

        sums = (docs.select("text").mapInArrow(train, "place int, step long, tokens long").groupBy("place")
                .agg(F.sum(F.col("step").cast("decimal(38,0)")).alias("step"), F.sum("tokens").alias("tokens")))
        sums.write.parquet(f"{home}/weights-{turn}")
        new = weights.astype(np.float64)
        for r in spark.read.parquet(f"{home}/weights-{turn}").toLocalIterator():
            new[r.place] += float(r.step) / r.tokens / STEPS
        weights = new.astype(np.float32)
    return Fitted(frequent, weights, buckets, known_words(counts, known), counts)


def score(docs: DataFrame, model: Fitted) -> DataFrame:
    """doc_id, n_tokens, sum_logprob, mean_logprob of the documents that the model was fitted to."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.frequent, model.weights, model.known, model.buckets))

    def start():
        words, vector, known, buckets = shared.value
        lookup, network = Shares(Vocabulary(words), known, buckets), Network.from_vector(vector)

        def run(texts):
            flat, sizes = split_words(texts)
            rows, shares, unknown = lookup(flat)
            each = network.log_probabilities(*laid_out(rows, sizes)) + shares
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            sums = np.diff(np.concatenate(([0], np.cumsum(each)))[bounds])
            cuts = np.searchsorted(unknown, bounds).tolist()
            rare = [flat[i] for i in unknown.tolist()]
            return [sizes, sums, [rare[a:b] for a, b in zip(cuts, cuts[1:])]]

        return run

    home = shared_dir(spark, "lm-scores")
    # Numbers of rows differ between attempts, so they are written before they are used twice.
    (per_text(docs, "n_tokens long, part double, rare array<binary>", start)
     .withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{home}/parts"))
    parts = spark.read.parquet(f"{home}/parts")
    # A rare word is outside the KNOWN most frequent ones, so none has a large part of the rows.
    logs = model.counts.select("word", F.round(F.log("n") * LOG_STEPS).cast("long").alias("log_n"))
    rest = (parts.select("row", F.explode("rare").alias("word")).join(logs, "word")
            .groupBy("row").agg(F.sum("log_n").alias("logs")))
    total = F.round(F.col("part") + F.coalesce("logs", F.lit(0)) / LOG_STEPS, 4)
    return (parts.select("row", "doc_id", "n_tokens", "part").join(rest, "row", "left")
            .select("doc_id", "n_tokens", total.alias("sum_logprob"),
                    F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_logprob")))


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS, known: int = KNOWN) -> DataFrame:
    return score(docs, fit(docs, rounds, known))
