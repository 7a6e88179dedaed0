import tracemalloc
import weakref
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import ODD_TEXTS

from crawlspark.llm import toxicity as X
from crawlspark.llm.common import kept_in_worker


@pytest.fixture(scope="module")
def scored(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return X.toxicity_scores(docs, labels).join(labels, "doc_id", "left").collect()


def test_every_document_has_a_score(scored, docs):
    assert Counter(r.doc_id for r in scored) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    for r in scored:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def toy(n=60):
    rng = np.random.default_rng(0)
    syllables = ["ba", "lo", "ri", "ten", "su", "mar", "vi", "do"]

    def word():
        return "".join(rng.choice(syllables, 3))

    texts, labels = [], []
    for i in range(n):
        words = [word() for _ in range(80)]
        if i % 2:
            for k in rng.choice(80, 3):
                words[k] = rng.choice(["gorblex", "zwickmuf"]) + rng.choice(["", "ing", "ed"])
        texts.append(" ".join(words).encode())
        labels.append(i % 2)
    return texts, np.array(labels), word


def test_unseen_forms_share_vectors():
    texts, labels, word = toy()
    model = X.train(texts, labels)
    clean = " ".join(word() for _ in range(60)).encode()
    plain, seen, unseen = model([clean, clean + b" gorblex", clean + b" gorblexx"])
    assert seen > 0.7 > plain and unseen > plain
    back = X.Model.from_bytes(model.to_bytes())
    assert np.allclose(back([clean, b""]), model([clean, b""]), atol=1e-4)


def test_held_out_labels_teach_nothing(spark):
    texts, labels, _ = toy()
    rows = [(i, t.decode(), int(y)) for i, (t, y) in enumerate(zip(texts, labels))]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    turned = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows],
                                   "doc_id long, toxic int")
    a = {r.doc_id: r.score for r in X.toxicity_scores(df.drop("toxic"), df.select("doc_id", "toxic")).collect()}
    b = {r.doc_id: r.score for r in X.toxicity_scores(df.drop("toxic"), turned).collect()}
    assert a == b


def test_odd_rows(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    got = X.toxicity_scores(odd, empty).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD_TEXTS) and {r.score for r in got} == {0.0}
    labels = spark.createDataFrame([(0, 0), (5, 1), (5, None), (None, 1), (4, 0), (8, 0), (4, 1), (18, 1), (19, 0), (20, 1)],
                                   "doc_id long, toxic int")
    got = X.toxicity_scores(odd, labels).collect()
    assert len(got) == len(ODD_TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert X.toxicity_scores(none, labels).count() == 0
    kept = X.without_toxic(odd, labels)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in got if not r.predicted)


def test_accuracy_on_held_out_documents(spark):
    """On the larger table; at sf0.001 there are too few labels to learn from."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = X.toxicity_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) >= 0.85


def held_out_rates(spark, folder):
    """Recall of the toxic class and false positive rate of the other on held-out documents."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = X.toxicity_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == k] for k in (1, 0))
    print(folder, "recall", sum(toxic), len(toxic), "false positives", sum(clean), len(clean))
    return sum(toxic) / len(toxic), sum(clean) / len(clean)


def test_recall_and_false_positives_on_held_out_documents(spark):
    """Accuracy alone would pass a model that finds nothing."""
    recall, wrong = held_out_rates(spark, "/root/testdata/sf0.1")
    assert recall >= 0.8 and wrong <= 0.05


def test_long_clean_texts_and_shifted_words(spark):
    """More windows do not make a clean text toxic, and a word more in front turns no verdict."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = X.Model.from_bytes(X.fit(docs, labels))
    rows = docs.join(labels.filter("toxic IS NOT NULL"), "doc_id").filter(X.held_out(docs.doc_id)).orderBy("doc_id").collect()
    texts = [(r.text or "").encode() for r in rows]
    toxic = np.array([r.toxic for r in rows])
    found = model(texts) >= X.THRESHOLD
    assert (found != (model([b"word " + t for t in texts]) >= X.THRESHOLD)).mean() < 0.005
    clean = [t for t, k in zip(texts, toxic) if k == 0]
    for many in (5, 20, 60):
        joined = [b" ".join(clean[i:i + many]) for i in range(0, len(clean) - many + 1, many)]
        assert (model(joined) >= X.THRESHOLD).mean() <= 0.05, many
    assert found[toxic == 1].mean() >= 0.85 and found[toxic == 0].mean() <= 0.02


def test_one_word_and_no_word():
    texts, labels, _ = toy()
    model = X.train([*texts, b"", b"gorblex"], np.append(labels, [0, 1]))
    empty, one, pair = model([b"", b"gorblex", b"gorblex gorblex"])
    assert one == pair > empty == X.sigmoid(model.offset)


def test_buckets_take_little_memory():
    """Of the n-grams of many words only a block is held in full width, and no number is an object."""
    rng = np.random.default_rng(3)
    words = ["".join(w).encode() for w in rng.choice(list("abcdefghijklmnop"), (20_000, 9))]
    tracemalloc.start()
    flat, starts = X.bags(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(flat)
    values, ends = rng.random(X.BUCKETS), [*starts[1:].tolist(), len(flat)]
    assert np.allclose(X.means(values, flat, starts), [values[flat[a:b]].mean() for a, b in zip(starts, ends)])
    assert X.means(values, *X.bags([])).size == 0


def test_training_starts_without_the_tables_of_another_operator():
    class Table:
        pass

    left = weakref.ref(kept_in_worker("another operator", Table))
    texts, labels, _ = toy(20)
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array([t.decode() for t in texts]), pa.array(labels)],
                                       names=["doc_id", "text", "label"])
    assert left() is not None
    assert [m.num_rows for m in X.train_in_task(iter([batch]))] == [1] and left() is None
