import random

import pytest
from conftest import by_row

from crawlspark.llm import decontamination as D

ITEM = "the quick brown fox jumps over the lazy dog and runs away from it all the way home again"


@pytest.fixture
def items(spark):
    rows = [(1, ITEM, 1), (2, None, 1), (3, "", 1), (4, "only three words", 1), (1, ITEM, 1), (5, "a a a a a a a a", 1)]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id int")


def slow(docs, items, share=0.8):
    out = []
    for i, t in docs:
        held = D.shingles_of(D.words_of((t or "").encode()))
        for k, u in items:
            wanted = D.shingles_of(D.words_of((u or "").encode()))
            if wanted and 10 * len(wanted & held) >= 10 * share * len(wanted):
                out.append((i, k, len(wanted), len(wanted & held)))
    return sorted(out)


def test_planted_and_odd_rows(spark, odd, none, items):
    words = ITEM.split()
    planted = [(100, "Before it. " + ITEM.upper() + "! And after " * 500), (101, " ".join(words[:17])), (102, " ".join(words[:10])),
               (103, "only, three; words"), (104, "only three words and more"), (105, "a " * 50),
               (106, " ".join([*words[:9], "wrong", *words[10:]]))]
    rows = spark.createDataFrame(planted, "doc_id long, text string")
    got = by_row(D.contained_items(rows, items), "doc_id", "item_id", "n_shingles", "n_found")
    assert got == slow(planted, [(r.item_id, r.text) for r in items.collect()])
    assert {r[:2] for r in got} == {(100, 1), (101, 1), (103, 4), (105, 5)}
    everything = odd.select("doc_id", "text").unionByName(rows)
    assert {r.doc_id for r in D.contained_items(everything, items).collect()} == {100, 101, 103, 105}
    assert D.contained_items(none, items).count() == 0
    assert D.contained_items(odd, items.limit(0)).count() == 0
    clean = D.clean_of(odd, items)
    assert clean.columns == odd.columns and clean.count() == odd.count()


def test_blocks_of_items_give_the_same(spark, docs, sf_dir, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = by_row(D.contained_items(docs, items), "doc_id", "item_id", "n_found")
    assert whole
    monkeypatch.setattr(D.item_blocks, "__defaults__", (400,))
    assert by_row(D.contained_items(docs, items), "doc_id", "item_id", "n_found") == whole


def test_minima_lose_nothing():
    for n in range(1, 200):
        assert D.needed(n) == max(1, -(-8 * n // 10))
        assert D.minima_count(n) > n - D.needed(n)


def test_parts_by_size_find_what_brute_force_finds():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice((1, 3, 4, 5, 6, 9, 14, 20, 40, 90, 200)))).encode()) for k in range(150)]
    block = D.ItemBlock(items)
    for part in block.parts:
        sizes = [len(block.shingles[i]) for i in part.least_hits]
        assert max(sizes) < 2 * min(1 << (n.bit_length() - 1) for n in sizes)
    assert len(block.parts) >= 8
    docs = []
    for k in range(200):
        text = rng.choice(items)[1].split()
        for _ in range(rng.randrange(1 + len(text) // 12)):
            text[rng.randrange(len(text))] = rng.choice((b"w1", b"other"))
        around = [w.encode() for w in rng.choices(words, k=rng.choice((0, 0, 7, 3000)))]
        docs.append((k, b" ".join(around + text + around).decode()))
    got = sorted((i, block.ids[j], n, f) for i, t in docs for j, n, f in block.search(t.encode()))
    want = slow(docs, [(i, t.decode()) for i, t in items])
    assert got == want and len(want) > 100
