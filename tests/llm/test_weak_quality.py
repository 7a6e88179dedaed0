from collections import Counter

import numpy as np
from conftest import ODD_TEXTS

from crawlspark.llm import weak_quality as W


def test_label_model_finds_the_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.7
    right = [0.9, 0.8, 0.75, 0.95]
    votes = np.stack([np.where(rng.random(20000) < 0.3, 0, np.where(rng.random(20000) < p, 1, -1) * np.where(truth, 1, -1))
                      for p in right], axis=1)
    patterns = sorted(Counter(map(tuple, votes.tolist())).items())
    share, table, good = W.label_model(patterns)
    assert abs(share - 0.7) < 0.03
    for k, p in enumerate(right):
        assert abs(table[1, k, 2] / (table[1, k, 0] + table[1, k, 2]) - p) < 0.04
    where = {p: g for (p, _), g in zip(patterns, good)}
    guess = np.array([where[tuple(v)] > 0.5 for v in votes.tolist()])
    assert (guess == truth).mean() > 0.9


def test_odd_rows(odd, none):
    got = W.quality_scores(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD_TEXTS)
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 and r.kept == (r.score >= W.THRESHOLD) for r in got)
    assert W.quality_scores(none).count() == 0


def test_agrees_with_labels_it_never_saw(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = W.quality_scores(docs).join(labels, "doc_id").filter("n_words >= 20").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) / len(rows) >= 0.97
    good = [r for r in rows if r.quality == 1]
    assert sum(r.kept for r in good) / len(good) >= 0.99


def test_shapes():
    assert W.shape(b"Hello,") == b"Aaa," and W.shape(b"") == b"" and W.shape("éàü###".encode()) == b"aa##"


def test_sample_is_bounded_by_features(docs, monkeypatch):
    seen = []
    plain = W.fitted
    monkeypatch.setattr(W, "fitted", lambda rows, posterior: seen.append(rows.count()) or plain(rows, posterior))
    n = W.quality_scores(docs).count()
    assert seen == [n]
    monkeypatch.setattr(W, "SAMPLE_FEATURES", 500)
    assert W.quality_scores(docs).count() == n and seen[1] < n / 4


def test_fit_in_a_task_is_the_fit(spark):
    rows = [([1], [3, 5], [0.5, 1.0]), ([-1], [4], [1.0]), ([1], [3], [1.0])]
    made = W.fitted(spark.createDataFrame(rows, "votes array<int>, at array<int>, value array<float>").repartition(3), {(1,): 0.9, (-1,): 0.1})
    assert (made == W.train([(at, value, {1: 0.9, -1: 0.1}[v[0]]) for v, at, value in sorted(rows)])).all()
