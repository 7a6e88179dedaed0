import random
from collections import Counter, defaultdict

import numpy as np
import xxhash
from conftest import ODD_TEXTS  # noqa: F401
from pyspark.sql import functions as F

from crawlspark.llm import simhash as H


def slow_fingerprint(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(points, bits=4):
    """doc ids by brute force over all pairs of distinct fingerprints."""
    fps = sorted(set(points.values()))
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for key, f in points.items():
        groups[root(f)].append(key)
    return {k: min((x[0] for x in g if x[0] is not None), default=None) for g in groups.values() for k in g}


def test_query_equals_brute_force(docs):
    got = H.near_duplicates(docs).collect()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    want = {(i, 0): slow_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == {k[0]: f for k, f in want.items()}
    classes = slow_components(want)
    assert {(r.doc_id, 0): r.component_id for r in got} == classes


def test_odd_rows(odd, none):
    got = H.near_duplicates(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD_TEXTS)
    assert {r.fp for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert {r.component_id for r in got if r.doc_id in (16, 17)} == {15}
    assert H.near_duplicates(none).count() == 0
    kept = H.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    named = [i for i in ids if i is not None and i != 15]
    assert sorted(named) == sorted(set(named)) and None in ids and ids.count(15) == 2  # two texts have the id 15
    assert 15 in ids and 16 not in ids and 17 not in ids and 1 in ids and 2 not in ids


def test_links_of_random_and_clustered_fingerprints(spark):
    rng = random.Random(5)
    points = {rng.getrandbits(64) for _ in range(400)} | {0, (1 << 64) - 1}
    for centre in rng.sample(sorted(points), 12):  # chains and clumps, one of them larger than a small cell
        near = centre
        for _ in range(12):
            near ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            points.add(near)
    clump = rng.getrandbits(64)
    points |= {clump ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    df = spark.createDataFrame([(H.signed(p),) for p in points], "fp long").repartition(5)
    edges = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in H.fingerprint_links(df).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    want = slow_components({(p, 0): p for p in points})
    parent = {p: p for p in points}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in edges:
        parent[root(a)] = root(b)
    least = defaultdict(list)
    for p in points:
        least[root(p)].append(p)
    assert {(p, 0): min(g) for g in least.values() for p in g} == want


def test_large_cell_costs_a_forest_only():
    fp = np.array(sorted({sum(1 << b for b in (i % 20, i // 20 % 20, i // 400)) for i in range(4000)}), dtype=np.uint64)
    a, b = H.cell_forest(fp, 4)
    assert len(a) <= len(fp) - 1
    assert len(set(a.tolist()) | set(b.tolist())) == len(fp)


def test_counts_bound_the_distance():
    rng = np.random.default_rng(2)
    x, y = (rng.integers(0, 1 << 63, 2000, dtype=np.uint64) for _ in range(2))
    y[::2] = x[::2] ^ np.uint64(5)
    lower = np.bitwise_count(H.counts_array(x) ^ H.counts_array(y))
    assert (lower <= np.bitwise_count(x ^ y)).all()


def test_no_group_loses_all_its_rows(spark):
    t, u = "some words of one text", "wholly other content here"
    rows = [(15, t), (16, t), (15, u), (None, t), (None, "a text without an id"), (None, "a text without an id"), (7, u + " and so on"), (7, u + " and so on")]
    for seed in range(3):
        docs = spark.createDataFrame([(i, x, 1) for i, x in rows], "doc_id long, text string, digest int").orderBy(F.rand(seed)).repartition(3)
        kept = H.one_of_each(docs)
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id or 0, r.text) for r in kept.collect())) == sorted([(15, t), (15, u), (0, "a text without an id"), (7, u + " and so on")])


def test_more_fingerprints_get_more_blocks_and_smaller_cells():
    chosen = [H.blocks_for(n) for n in (0, 1, 10**6, 10**7, 10**8, 10**9, 10**12)]
    assert chosen == sorted(chosen) and chosen[0] == 6 and chosen[-1] == H.MOST_BLOCKS
    for n, blocks in zip((10**6, 10**7, 10**8, 10**9), chosen[2:]):
        widths = sorted(np.diff([H.SEGMENTS * i // blocks for i in range(blocks + 1)]).tolist())
        assert n / 2 ** sum(widths[: blocks - H.MAX_BITS]) < H.CELL_POINTS


def test_any_number_of_blocks_gives_the_same_classes(docs):
    want = {(r.doc_id, r.component_id) for r in H.near_duplicates(docs).collect()}
    assert {(r.doc_id, r.component_id) for r in H.near_duplicates(docs, blocks=8).collect()} == want


def test_hot_fingerprints_keep_all_rows(spark, docs):
    copies = spark.range(10_000, 13_000).select(F.col("id").alias("doc_id"), F.lit("one text that is very common").alias("text"))
    rows = docs.select("doc_id", "text").unionByName(copies)
    got = H.near_duplicates(rows).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows.collect())
    assert {r.component_id for r in got if r.doc_id >= 10_000} == {10_000}
