import math
import re
from collections import Counter

import duckdb
import numpy as np
from compare import differences
from conftest import by_row

from crawlspark.llm import lexical_search as L
from crawlspark.llm.oracles import ORACLES
from crawlspark.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def slow_ranking(docs, items, top=20):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    found = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs]
    held = [(i, c) for i, c in found if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out, whole = [], {}
    for item, text in items:
        whole.setdefault(item, Counter()).update(TERM.findall(lowered(text)))
    for item, query in whole.items():
        scores = []
        for doc_id, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, k in query.items() if t in c)
            if s > 0:
                scores.append((-s, doc_id is not None, doc_id or 0, doc_id))
        out += [(item, k + 1, doc_id, -s) for k, (s, _, _, doc_id) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


def got(docs, items, **more):
    return by_row(L.best_documents(docs, items, **more), "item_id", "rank", "doc_id", "score")


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    name = "op11_lexical_search"
    assert differences(QUERIES[name](spark, sf_dir), con.sql(ORACLES[name])) is None


def test_odd_rows(spark, odd, none):
    texts = [(1, "same text"), (2, None), (3, ""), (4, "é ñ 日本語 words"), (4, "one more row"), (None, "text"), (5, "nowhere-to-be-found"),
             (6, "word word word"), (7, "WON'T\x00it's")]
    items = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "item_id long, text string, doc_id int, score int")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(odd, items) == slow_ranking(docs, texts)
    assert got(odd, items, top=2) == slow_ranking(docs, texts, 2)
    assert got(none, items) == [] and got(odd, items.limit(0)) == []


def test_blocks_of_items_give_the_same(spark, odd):
    texts = [(k, f"same text {k} words one two three line") for k in range(30)]
    items = spark.createDataFrame(texts, "item_id long, text string")
    assert got(odd, items, block_chars=200) == got(odd, items)


def test_buckets_prune_without_loss(monkeypatch):
    """Small buckets over random vectors, against the whole product; pruning must have happened."""
    rng = np.random.default_rng(3)
    n_docs, n_terms = 4000, 300
    rows = [np.unique(rng.zipf(1.3, rng.integers(1, 60)) % n_terms) for _ in range(n_docs)]
    tfs = [rng.integers(1, 9, len(r)) for r in rows]
    sizes = np.array([len(r) for r in rows])
    term, tf = np.concatenate(rows), np.concatenate(tfs).astype(np.int64)
    n = np.add.reduceat(tf, np.cumsum(sizes) - sizes) + 5
    weight = L.weights(np.bincount(term, minlength=n_terms), n_docs)
    items = [(np.unique(rng.integers(0, n_terms, 12)), None) for _ in range(25)]
    items = [(t, rng.integers(1, 4, len(t))) for t, _ in items]
    seen = []
    true_search = L.Search.search_bucket
    monkeypatch.setattr(L.Search, "search_bucket", lambda self, chosen, *a: (seen.append(len(chosen)), true_search(self, chosen, *a))[1])
    search = L.Search(items, weight, n_docs, int(n.sum()), np.zeros(len(items)), bucket=64)
    ids = rng.permutation(n_docs)
    search.add(ids, n, sizes, term, tf, False)
    m = 75 + 25 * n * n_docs // int(n.sum())
    dense = np.zeros((n_docs, n_terms), dtype=np.int64)
    dense[np.repeat(np.arange(n_docs), sizes), term] = weight[term] * (10**9 * tf // (1000 * tf + 12 * np.repeat(m, sizes)))
    for k, (t, q) in enumerate(items):
        scores = dense[:, t] @ q
        order = np.lexsort((ids, -scores))[: L.TOP]
        assert search.best[k][0].tolist() == scores[order].tolist()
        assert search.best[k][1].tolist() == ids[order].tolist()
    assert sum(seen) < len(items) * -(-n_docs // 64)
