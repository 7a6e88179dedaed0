"""Toxicity scores from subword-bag embeddings with a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams and of itself; its vector is the mean of theirs, a window of two
words that follow each other (a lone word: of one) is the mean of both, and a linear softmax gives the window's
probability. Windows overlap, so that a word more in front of a text moves none. A misspelling that was never seen
shares most n-grams with the word it came from.

The document's logit is the largest of its windows, less what the largest of so many clean windows gains by chance: the
largest of n grows as ``spread`` * log(n), so this is taken off for the windows beyond those of the median document of
the sample. ``spread`` is that of the largest windows of the sample's clean documents (the scale of an extreme value
distribution, sqrt(6) / pi times the standard deviation). One averaged bag for the whole document finds 1 to 8 of 144
held-out toxic documents of some 250 words, so it is not used.

Training: labelled rows whose crc32(doc_id as text) mod 3 is not 1, at most ``PER_CLASS`` of each class (those with
the smallest hash of doc_id), in one task of bounded size; whole texts. Scores use the text alone.

Defined cases: a null or empty text is a window without words and gets the score of the bias; null labels or ids teach
nothing; several labels of a doc_id count as their largest; with fewer than two classes every score is 0; repeated
rows and equal doc_ids stay as rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import io
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_texts, kept_in_worker, per_text, texts_of

BUCKETS, DIM, SHORTEST, LONGEST = 1 << 16, 8, 3, 5
PER_CLASS, EPOCHS, WARM_UP, RATE, DAMPING, SEED = 1500, 24, 5, 5.0, 0.02, 1
THRESHOLD = 0.7
KEPT_WORDS = 250_000
BAGGED = 1 << 14  # words whose n-grams are held at a time
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FOLDS, HELD_OUT = 3, 1


def words_of(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().split()


def subwords(word: bytes, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the word and of its n-grams of characters, between marks of its ends."""
    bare = word.strip(PUNCTUATION) or word
    marked = f"<{bare.decode('utf-8', 'replace')}>"
    size = len(marked)
    grams = [marked[i:i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(size - n + 1)]
    return [zlib.crc32(g.encode()) % buckets for g in {marked, *grams}]


def bags(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Flat buckets of all words and where each word starts."""
    flat, starts = array("i"), array("q")  # not lists: a number in a list takes nine times as much memory
    for w in words:
        starts.append(len(flat))
        flat.extend(subwords(w))
    return np.frombuffer(flat, dtype=np.int32), np.frombuffer(starts, dtype=np.int64)


def blocks(flat: np.ndarray, starts: np.ndarray):
    """Some words at a time: their places, their buckets, and where each starts in these."""
    for i in range(0, len(starts), BAGGED):
        some = starts[i:i + BAGGED]
        stop = starts[i + BAGGED] if i + BAGGED < len(starts) else len(flat)
        yield slice(i, i + len(some)), flat[some[0]:stop].astype(np.int64), some - some[0]


def means(values: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts))
    for at, buckets, first in blocks(flat, starts):
        out[at] = np.add.reduceat(values[buckets], first) / np.diff(first, append=len(buckets))
    return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """Embeddings (buckets x DIM), the softmax layer (DIM x 2 with two biases), and the correction for length.

    ``length`` holds the spread of the largest windows and the number of windows from which on it counts.
    """

    def __init__(self, embeddings, layer, bias, length=(0.0, 1.0)):
        self.embeddings, self.layer, self.bias, self.length = embeddings, layer, bias, np.asarray(length, dtype=float)
        self.slope = embeddings @ (layer[:, 1] - layer[:, 0])  # what a bucket adds to the logit of a word
        self.offset = float(bias[1] - bias[0])
        self.words: dict[bytes, float] = {}

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, e=self.embeddings.astype(np.float32), l=self.layer, b=self.bias, n=self.length)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes):
        z = np.load(io.BytesIO(data))
        return cls(z["e"].astype(np.float64), z["l"], z["b"], z["n"])

    def learn_words(self, words) -> None:
        if len(self.words) > KEPT_WORDS:
            self.words = {}
        new = [w for w in words if w not in self.words]
        for i in range(0, len(new), BAGGED):
            some = new[i:i + BAGGED]
            self.words.update(zip(some, means(self.slope, *bags(some)).tolist()))

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        self.learn_words(set().union(*split))
        out, get, (spread, usual) = np.empty(len(texts)), self.words.__getitem__, self.length
        for k, words in enumerate(split):
            logit = 0.0
            if words:
                values = np.fromiter(map(get, words), dtype=np.float64, count=len(words))
                logit = float((values[1:] + values[:-1]).max() / 2 if len(words) > 1 else values[0])
                logit -= spread * max(0.0, np.log(max(1, len(words) - 1) / usual))
            out[k] = logit + self.offset
        return sigmoid(out)


class NoModel:
    def __call__(self, texts):
        return np.zeros(len(texts))


def train(texts: list[bytes], labels: np.ndarray) -> Model:
    """Embeddings and layer together, by gradient descent on the whole sample.

    At first every window of a document carries its label, then the one that scores highest. A bucket's step is scaled by
    the root of its frequency, which is how chance differences between the classes grow: neither frequent nor rare
    n-grams win by chance. ``DAMPING`` is the frequency, in documents, below which a bucket is held back.
    """
    rng = np.random.default_rng(SEED)
    seen: dict[bytes, int] = {}
    ids, window_of, doc_of, windows = [], [], [], 0
    for d, text in enumerate(texts):
        words = words_of(text)
        row = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
        n = max(1, len(words) - 1)
        ids.append(np.stack((row[:-1], row[1:]), axis=1).ravel() if len(row) > 1 else row)
        window_of.append(windows + (np.arange(2 * n) // 2 if len(row) > 1 else np.arange(len(row))))
        doc_of.append(np.full(n, d))
        windows += n
    ids, window_of, doc_of = map(np.concatenate, (ids, window_of, doc_of))
    size = np.maximum(1, np.bincount(window_of, minlength=windows))
    flat, starts = bags(list(seen))
    bag = np.diff(np.append(starts, len(flat)))
    embeddings, layer, bias = rng.normal(0, 0.01, (BUCKETS, DIM)), rng.normal(0, 1, (DIM, 2)), np.zeros(2)
    layer /= np.linalg.norm(layer[:, 1] - layer[:, 0])
    target, each = labels[doc_of].astype(float), np.bincount(doc_of)[doc_of]
    first = np.concatenate(([0], np.flatnonzero(np.diff(doc_of)) + 1))
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))

    def to_buckets(by_window):
        by_word = np.bincount(ids, (by_window / size)[window_of], minlength=len(starts))
        share, out = by_word / bag, np.zeros(BUCKETS)
        for at, buckets, _ in blocks(flat, starts):
            np.add.at(out, buckets, np.repeat(share[at], bag[at]))
        return out

    scale = np.sqrt(to_buckets(np.ones(windows)) / windows + DAMPING / len(texts))
    largest = 0.0
    for epoch in range(EPOCHS):
        side = layer[:, 1] - layer[:, 0]
        per_word = means(embeddings @ side, flat, starts)
        logits = np.bincount(window_of, per_word[ids], minlength=windows) / size + bias[1] - bias[0]
        if epoch < WARM_UP:
            share = weight[doc_of] / each
        else:
            share = np.zeros(windows)
            best = np.lexsort((-logits, doc_of))[first]
            share[best] = weight[doc_of[best]]
        slope = (sigmoid(logits) - target) * share
        by_bucket = to_buckets(slope) / scale
        largest = max(largest, float(np.abs(by_bucket).max()), 1e-12)
        d_side = by_bucket @ embeddings
        embeddings -= RATE / largest * np.outer(by_bucket, side)
        layer -= 0.001 * RATE / largest * np.stack((-d_side, d_side), axis=1) / max(1.0, float(np.abs(d_side).max()))
        bias -= 0.3 * np.array([-slope.sum(), slope.sum()])
    per_word = means(embeddings @ (layer[:, 1] - layer[:, 0]), flat, starts)
    logits = np.bincount(window_of, per_word[ids], minlength=windows) / size
    largest = np.maximum.reduceat(logits, first)
    spread = float(np.std(largest[labels == 0])) * np.sqrt(6) / np.pi
    return Model(embeddings, layer, bias, (spread, float(np.median(np.bincount(doc_of)))))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


def train_in_task(batches):
    """The model's bytes from batches of doc_id, text and label; nothing with fewer than two classes."""
    kept_in_worker("toxicity training", lambda: None)  # the tables that an earlier operator left in the worker go
    ids, texts, labels = [], [], []
    for batch in batches:
        ids += batch.column(0).to_pylist()
        texts += texts_of(batch.column(1))
        labels += batch.column(2).to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    labels = np.array([labels[i] for i in order])
    if len(set(labels.tolist())) == 2:
        model = train([texts[i] for i in order], labels).to_bytes()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS):
    """The model's bytes, or None with fewer than two classes."""
    known = (labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
             .filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")))
    ranked = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    sample = ranked[0].unionByName(ranked[1])  # at most 2 * per_class rows, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    made = rows.select("doc_id", "text", "label").repartition(1).mapInArrow(train_in_task, "model binary").first()
    return bytes(made.model) if made else None


def scorer(spark, model: bytes | None):
    """The function that a task starts with."""
    shared = spark.sparkContext.broadcast(model)  # BUCKETS * DIM floats
    key = ("toxicity", zlib.crc32(model) if model else 0)

    def start():
        return kept_in_worker(key, lambda: Model.from_bytes(shared.value)) if shared.value else NoModel()

    return start


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    make = scorer(docs.sparkSession, fit(docs, labels, per_class))

    def start():
        score = make()
        return lambda texts: [score(texts)]

    scored = per_text(docs, "score double", start)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below the threshold, all columns as they are."""
    make = scorer(docs.sparkSession, fit(docs, labels, per_class))

    def start():
        score = make()
        return lambda texts: score(texts) < threshold

    return keep_texts(docs, start)
