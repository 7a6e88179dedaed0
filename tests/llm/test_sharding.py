import hashlib
import random
import zlib
from collections import defaultdict
from itertools import accumulate

import pytest
from conftest import ODD_TEXTS

from crawlspark.llm import sharding as H


def slow_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, filled = (low + high) // 2, 1, 0
        for s in sizes:
            if filled + s > mid:
                used, filled = used + 1, 0
            filled += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("n, hot", [(1, 0), (3, 0), (40, 0), (400, 300_000), (900, 0)])
def test_capacity_is_the_smallest_over_all_groups(spark, monkeypatch, n, hot):
    monkeypatch.setattr(H, "FIRST_HEX", 1)  # few units at first, so that they must be split
    monkeypatch.setattr(H, "MORE_HEX", 1)
    rng = random.Random(n)
    groups = sorted((hashlib.sha256(str(i).encode()).hexdigest(), rng.choice([1, 5, rng.randint(1, 4000)])) for i in range(n))
    if hot:
        groups[n // 2] = (groups[n // 2][0], hot)
    capacity, cuts = H.cut_points(spark.createDataFrame(groups, "digest string, group_size long"), 16)
    assert capacity == slow_capacity([s for _, s in groups], 16)
    filled, last = defaultdict(int), 0
    for digest, size in groups:
        shard = next((k for k, c in enumerate(cuts) if c and digest[:len(c)] <= c), 15)
        assert shard >= last
        filled[shard] += size
        last = shard
    assert max(filled.values()) <= capacity


def test_even_cuts_stay_under_the_capacity():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.choice([1, 3, rng.randint(1, 2000)]) for _ in range(rng.randint(1, 60))]
        shards = rng.randint(1, 16)
        capacity, ends = H.smallest_capacity(sizes, shards), [0, *accumulate(sizes)]
        cuts = [0, *H.even_cuts(ends[1:], capacity, shards)]
        assert cuts[-1] == len(sizes)
        assert all(a <= b and ends[b] - ends[a] <= capacity for a, b in zip(cuts, cuts[1:]))


def check(rows, texts):
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    slots, crc_shards = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        crc_shards[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= k < 16 for k in slots) and all(len(s) == 1 for s in crc_shards.values())


def test_odd_rows(odd, none):
    check(H.shards(odd).collect(), [t for _, t in ODD_TEXTS])
    assert H.shards(none).count() == 0


def test_whole_documents(docs):
    rows, texts = H.shards(docs).collect(), [r.text for r in docs.select("text").collect()]
    check(rows, texts)
    groups = defaultdict(int)
    for t in texts:
        groups[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    filled = defaultdict(int)
    for r in rows:
        filled[r.shard] += r.size
    assert max(filled.values()) == slow_capacity([groups[k] for k in sorted(groups)], 16) or \
        max(filled.values()) <= slow_capacity([groups[k] for k in sorted(groups)], 16)


def test_no_python_in_the_plan(docs):
    plan = H.shards(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
