import zlib
from collections import Counter

import numpy as np
from conftest import ODD_TEXTS

from crawlspark.llm import lm_scoring as L


def small_network(seed=3):
    rng = np.random.default_rng(seed)
    return L.Network.start(rng.random(L.ROWS) * 100)


def slow_log_probability(net, row, i):
    w = {k: v.astype(np.float64) for k, v in net.w.items()}
    h = np.tanh(sum(w["embed"][row[i + o]] * w["place"][k] for k, o in enumerate(L.OFFSETS)) + w["bias"])
    c, j = divmod(int(row[i]), L.IN_CLASS)
    a, b = h @ w["cls"] + w["cls_bias"], h @ w["word"][c] + w["word_bias"][c]
    return a[c] - np.log(np.exp(a).sum()) + b[j] - np.log(np.exp(b).sum())


def test_probabilities_are_those_of_the_network_and_sum_to_one():
    net, rng = small_network(), np.random.default_rng(0)
    row = rng.integers(0, L.ROWS, 60)
    at = np.arange(L.REACH, 60 - L.REACH)
    got = net.log_probabilities(row, at, batch=17)
    assert np.allclose(got, [slow_log_probability(net, row, i) for i in at], atol=1e-4)
    total = 0.0
    for token in range(L.ROWS):
        row[30] = token
        total += np.exp(net.log_probabilities(row, np.array([30]))[0])
    assert abs(total - 1) < 1e-3


def test_training_follows_the_gradient():
    net, rng = small_network(), np.random.default_rng(1)
    row = np.tile(rng.integers(0, L.ROWS, 12), 200)
    at = np.arange(L.REACH, len(row) - L.REACH)
    before = net.log_probabilities(row, at).mean()
    for _ in range(15):
        net.learn(row, rng.permutation(at), rate=3.0, batch=256)
    assert net.log_probabilities(row, at).mean() > before + 1
    back = L.Network.from_vector(net.vector())
    assert np.allclose(back.log_probabilities(row, at), net.log_probabilities(row, at))


def test_counts_cover_all_documents(docs):
    got = {bytes(r.word): r.n for r in L.word_counts(docs).collect()}
    assert got == Counter(w for r in docs.select("text").collect() for w in (r.text or "").encode().lower().split())


def test_scores_of_documents(docs):
    first = {r.doc_id: r for r in L.pseudo_likelihood(docs).collect()}
    again = {r.doc_id: r for r in L.pseudo_likelihood(docs).collect()}
    assert first == again
    for r in docs.select("doc_id", "text").collect():
        n = len((r.text or "").encode().split())
        assert first[r.doc_id].n_tokens == n and first[r.doc_id].sum_logprob <= 0


def test_odd_rows(odd, none):
    got = L.pseudo_likelihood(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD_TEXTS)
    assert all((r.sum_logprob, r.mean_logprob) == (0.0, None) for r in got if r.doc_id in (1, 2, 3))
    assert L.pseudo_likelihood(none).count() == 0


def test_words_of_a_bucket_have_their_own_probabilities(spark):
    """Alike but for one word of the same bucket, two texts differ by the logarithm of the words' counts."""
    frequent = [f"w{k}" for k in range(L.FREQUENT)]
    a, b = "rare", next(w for k in range(10**6) if zlib.crc32((w := f"x{k}").encode()) % L.HASHED == zlib.crc32(b"rare") % L.HASHED)
    texts = [" ".join(frequent)] * 6 + [f"w1 w2 {w} w3 w4" for w in (a, b)] + [a, f"{a} {a}", None, f"other {a}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    by_join = {r.doc_id: r.sum_logprob for r in L.pseudo_likelihood(df, known=0).collect()}
    for known in (L.FREQUENT, L.KNOWN):
        found = {r.doc_id: r.sum_logprob for r in L.pseudo_likelihood(df, known=known).collect()}
        assert all(abs(found[i] - by_join[i]) < 2e-4 for i in by_join) and len(found) == len(texts)
    assert abs(by_join[6] - by_join[7] - np.log(5)) < 3e-4
    model = L.fit(df)
    assert model.buckets.sum() == 7 and len(L.known_words(model.counts, L.FREQUENT + 1)) == L.FREQUENT + 1


def test_every_position_is_trained_on_once(spark, tmp_path, monkeypatch):
    """Texts of one to twenty words, each word once, so that the targets name the positions."""
    words = iter(range(10**6))
    texts = [" ".join(f"w{next(words)}" for _ in range(n)) for n in [1, 1, 2, 3, 20, 7, 1, 5, 6]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)

    class Noted(L.Network):
        def learn(self, row, places, *more):
            with open(tmp_path / "targets", "a") as f:
                f.writelines(f"{i}\n" for i in row[places].tolist())

    monkeypatch.setattr(L, "Network", Noted)
    model = L.fit(df)
    learnt = Counter(map(int, (tmp_path / "targets").read_text().split()))
    assert learnt == Counter(L.Vocabulary(model.frequent).ids.values()) and sum(learnt.values()) == next(words)


def test_more_frequent_words_than_can_be_known(spark):
    rows = [(w.encode(), n) for w, n in [("a", 70000), ("b", 90000), ("c", 70000), ("d", 65536), ("e", 3)]]
    counts = spark.createDataFrame(rows, "word binary, n long")
    assert L.known_words(counts, 2) == [(b"b", 90000), (b"a", 70000)]
    assert {w for w, _ in L.known_words(counts, 4)} == {b"a", b"b", b"c", b"d"}
    assert len(L.known_words(counts, 9)) == 5 and L.known_words(counts.limit(0), 2) == []
