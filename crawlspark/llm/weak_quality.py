"""Quality scores without hand labels: a weak-label model and a hashed linear scorer.

Heuristic labellers vote good, bad or abstain on every document. Expectation-maximisation over the counts of all vote
patterns estimates how often each labeller gives each vote for good and for bad documents, and so the probability that
a document of a pattern is good. These probabilities are the labels of a logistic regression over hashed features:
shapes of words and ranges of the measures.

The votes and features of all documents are computed once and written; there are at most 3 to the power of the
labellers many patterns, whatever the input. The scorer is trained in one task on a sample of about ``SAMPLE`` documents
with about ``SAMPLE_FEATURES`` features (all, if they are fewer), drawn by a hash: both bounds hold whatever the number
and length of the documents, and only the weights come to the driver.

Defined cases: a null or empty text has no word, is voted bad by the length labeller and gets a score like any other;
with a single pattern every document has the prior; repeated rows and equal doc_ids stay as rows; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import kept_in_worker, per_text
from .quality_rules import MEASURES, measure

GOOD, BAD, ABSTAIN = 1, -1, 0
BUCKETS, SAMPLE, EPOCHS, RATE = 1 << 14, 20_000, 200, 2.0
SAMPLE_FEATURES = 4_000_000
EM_ROUNDS, PRIOR = 200, 0.8
THRESHOLD = 0.5
KEPT_WORDS = 400_000
NAMES = [part.split()[0] for part in MEASURES.split(", ")]


def ratio(a, b):
    return a / b if b else 0.0


# Name -> a labeller of the measures' values. Most speak up only for one fault; two also speak for good text.
LABELLERS = {
    "length": lambda m: BAD if m["n_words"] < 20 else GOOD if m["n_words"] >= 60 else ABSTAIN,
    "windows": lambda m: BAD if ratio(m["n_repeat_words"], m["n_words"]) > 0.3 else ABSTAIN,
    "symbols": lambda m: BAD if ratio(m["n_symbols"], m["n_words"]) > 0.3 else ABSTAIN,
    "lines": lambda m: BAD if ratio(m["n_dup_lines"], m["n_lines"]) > 0.6 else ABSTAIN,
    "upper": lambda m: BAD if ratio(m["n_upper"], m["n_letters"]) > 0.4 else ABSTAIN,
    "marks": lambda m: BAD if ratio(m["n_marks"], m["n_words"]) > 0.3 else ABSTAIN,
    "echo": lambda m: BAD if ratio(m["n_same_next"], m["n_words"]) > 0.2 else ABSTAIN,
    "plain": lambda m: GOOD if m["n_words"] and ratio(m["n_symbols"] + m["n_marks"], m["n_words"]) < 0.05
    and ratio(m["n_repeat_words"], m["n_words"]) < 0.2 and ratio(m["n_upper"], m["n_letters"]) < 0.2 else ABSTAIN,
}

# ASCII letters and digits by kind, every byte of other letters as a small letter, the rest as it is.
_KIND = bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("9") if 48 <= c <= 57 else c
              for c in range(256))


def shape(word: bytes) -> bytes:
    """The word's characters by kind, runs of a kind shortened to two."""
    kinds, out = word.translate(_KIND), bytearray()
    for c in kinds:
        if len(out) < 2 or out[-1] != c or out[-2] != c:
            out.append(c)
    return bytes(out[:12])


def bucket(name: bytes) -> int:
    return zlib.crc32(name) % BUCKETS


def features_of(words: list[bytes], measures: dict[str, int], shapes: dict[bytes, int]) -> dict[int, float]:
    """Hashed features: shares of word shapes (they sum to 1) and the range of each measure (1 each)."""
    out: dict[int, float] = {}
    if words:
        codes, counts = np.unique(np.fromiter(map(shapes.__getitem__, words), np.int64, len(words)), return_counts=True)
        out = dict(zip(codes.tolist(), (counts / len(words)).tolist()))
    n = max(1, measures["n_words"])
    ranges = {"length": n.bit_length(), **{k: min(20, int(20 * v / n)) for k, v in measures.items() if k != "n_words"}}
    for k, v in ranges.items():
        b = bucket(f"{k}:{v}".encode())
        out[b] = out.get(b, 0.0) + 1.0
    return out


def votes_and_features(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, votes (one array entry for each labeller) and the features, from one pass over the texts."""

    def start():
        shapes = kept_in_worker("word shapes", dict)
        labellers = list(LABELLERS.values())

        def run(texts):
            if len(shapes) > KEPT_WORDS:
                shapes.clear()
            rows = []
            for text in texts:
                words = text.split()
                for w in words:
                    if w not in shapes:
                        shapes[w] = bucket(b"shape:" + shape(w))
                m = dict(zip(NAMES, measure(text)))
                found = features_of(words, m, shapes)
                rows.append((m["n_words"], [f(m) for f in labellers], list(found), list(found.values())))
            return list(zip(*rows))

        return run

    return per_text(docs, "n_words long, votes array<int>, at array<int>, value array<float>", start)


def label_model(patterns: list[tuple[tuple[int, ...], int]], rounds: int = EM_ROUNDS, prior: float = PRIOR):
    """Expectation-maximisation over vote patterns and their counts.

    Returns the share of good documents, the probabilities [class, labeller, vote + 1], and for each pattern the
    probability that it is good. It starts from the balance of the votes.
    """
    votes = np.array([p for p, _ in patterns], dtype=np.int64) + 1
    counts = np.array([n for _, n in patterns], dtype=float)
    balance = (votes - 1).sum(axis=1)
    good = np.where((votes == 0).any(axis=1), np.where(balance > 0, 0.3, 0.1), 0.9)
    one_hot = np.eye(3)[votes]  # pattern, labeller, vote
    share = prior
    for _ in range(rounds):
        each = np.stack((counts * (1 - good), counts * good))
        table = np.einsum("cp,plv->clv", each, one_hot) + 0.1
        table /= table.sum(axis=2, keepdims=True)
        share = float((each[1].sum() + prior) / (counts.sum() + 1))
        log = np.einsum("plv,clv->cp", one_hot, np.log(table)) + np.log([[1 - share], [share]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return share, table, good


def train(rows, epochs: int = EPOCHS, rate: float = RATE) -> np.ndarray:
    """Weights of the hashed features, and the bias last; rows hold (buckets, values, probability of good)."""
    at = np.array([b for r in rows for b in r[0]], dtype=np.int64)
    value = np.array([v for r in rows for v in r[1]], dtype=float)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    target = np.array([r[2] for r in rows])
    weights = np.zeros(BUCKETS + 1)
    for _ in range(epochs if len(rows) else 0):
        z = np.bincount(row, weights[at] * value, minlength=len(rows)) + weights[-1]
        slope = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / len(rows)
        weights[:-1] -= rate * np.bincount(at, slope[row] * value, minlength=BUCKETS)
        weights[-1] -= rate * slope.sum()
    return weights


def fitted(chosen: DataFrame, posterior: dict[tuple[int, ...], float]) -> np.ndarray:
    """The weights of ``train`` on the rows (votes, at, value), computed in a task; zero without rows."""
    def fit(batches):
        rows = sorted((tuple(votes), at, value) for batch in batches for votes, at, value in zip(*[c.to_pylist() for c in batch.columns]))
        weights = train([(at, value, posterior[votes]) for votes, at, value in rows])
        yield pa.RecordBatch.from_pydict({"weights": pa.array([weights.astype("<f8").tobytes()], pa.binary())})

    made = chosen.select("votes", "at", "value").repartition(1).mapInArrow(fit, "weights binary").first()
    return np.frombuffer(made.weights, "<f8") if made else np.zeros(BUCKETS + 1)


def quality_scores(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, posterior (of the votes), score (of the linear scorer) and kept."""
    spark = docs.sparkSession
    home = shared_dir(spark, "weak-quality")
    votes_and_features(docs).write.parquet(f"{home}/features")
    rows = spark.read.parquet(f"{home}/features")
    counted = rows.groupBy("votes").agg(F.count("*").alias("n"), F.sum(F.size("at")).alias("features")).collect()
    patterns = sorted((tuple(r.votes), r.n) for r in counted)
    _, _, good = label_model(patterns) if patterns else (PRIOR, None, [])
    posterior = {p: float(g) for (p, _), g in zip(patterns, good)}
    # The share of the hashes that holds about ``sample`` rows: no task sorts candidates of all partitions.
    share = min(1.0, sample / max(1, sum(r.n for r in counted)), SAMPLE_FEATURES / max(1, sum(r.features for r in counted)))
    drawn = F.pmod(F.xxhash64("doc_id", "at"), F.lit(1 << 30)) <= int(share * (1 << 30))
    weights = fitted(rows.filter(drawn), posterior)
    shared = spark.sparkContext.broadcast((weights, posterior))  # BUCKETS numbers; one for each pattern

    def score(batches):
        weights, posterior = shared.value
        for batch in batches:
            votes, at, value = (batch.column(i) for i in (2, 3, 4))
            row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(at).to_numpy(zero_copy_only=False))
            z = np.bincount(row, weights[at.flatten().to_numpy()] * value.flatten().to_numpy(), minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([posterior[tuple(v)] for v in votes.to_pylist()], pa.float64()),
                pa.array(1 / (1 + np.exp(-np.clip(z + weights[-1], -40, 40))), pa.float64())], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("posterior", pa.float64()), ("score", pa.float64())])
    scored = rows.select("doc_id", "n_words", "votes", "at", "value").mapInArrow(
        score, "doc_id long, n_words long, posterior double, score double")
    return scored.withColumn("kept", F.col("score") >= threshold)
