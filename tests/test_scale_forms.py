"""Forms for large inputs equal the plain ones: loaded patterns, hot hosts, corpus BM25, latency sketches, busy seconds."""

import random
import time

import pytest
from pyspark.sql import functions as F

from crawlspark.functions import blocks as B
from crawlspark.operators import cleaning, learning, races, routing


def test_loaded_patterns_equal_brute_force(spark):
    rnd = random.Random(2)
    urls = ["https://a.example.com/" + "/".join("".join(rnd.choices("abcd-", k=5)) for _ in range(4)) for _ in range(200)]
    urls += ["", None, "https://é.example/ÜBER", "ab"]
    patterns = ["".join(rnd.choices("abcd-/", k=rnd.randrange(1, 6))) for _ in range(300)] + ["über", "É", "", None, "https://a.", "zz", "ABCD"]
    left = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    right = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    got = routing.containing(left, right).collect()
    want = {(i, p.lower()) for i, u in enumerate(urls) if u for p in patterns if p and p.lower() in u.lower()}
    assert {(r.page_id, r.pattern) for r in got} == want and len(got) == len(want)


def test_a_hundred_thousand_patterns(spark):
    urls = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h/"), F.md5(F.col("id").cast("string"))).alias("url"))
    some = urls.select(F.substring("url", 12, 9).alias("pattern"))
    patterns = some.unionAll(spark.range(100_000).select(F.substring(F.sha2(F.concat(F.lit("x"), F.col("id")), 256), 1, 9).alias("pattern")))
    start = time.perf_counter()
    got = routing.containing(urls, patterns).groupBy("page_id").count().collect()
    assert len(got) == 2000 and time.perf_counter() - start < 60


def test_hot_hosts_are_answered_where_they_are_read(spark):
    state = spark.createDataFrame([("hot.example", "jina", 3), ("b.example", "pdf", 2)], "cache_key string, decision string, score int")
    hosts = ["www.hot.example"] * 5000 + [f"h{k}.b.example" for k in range(3000)] + ["none.example"] * 1990 + [None] * 10
    urls = spark.createDataFrame([(k, h) for k, h in enumerate(hosts)], "page_id long, host string").repartition(8)
    plain, split = routing.cached_route(urls, state), routing.cached_route(urls, state, hot=4)
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))
    assert routing.frequent_hosts(urls, 4) == ["www.hot.example", "none.example", "h0.b.example", "h1.b.example"][:2]
    sizes = sorted(r["count"] for r in split.filter("host = 'www.hot.example'").groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]  # no task above twice the median


def test_corpus_bm25_of_one_page_is_the_page_form(spark):
    html = "".join(f"<p>{t}</p>" for t in ("red fish", "blue fish swims far away", "one two three", "red red blue"))
    page = spark.createDataFrame([(1, html, "clash")], "page_id long, html string, blocks string")
    want = {(r.page_id, r.idx, r.score) for r in cleaning.bm25_blocks(page, "red fish", 0.0).collect()}
    assert {(r.page_id, r.idx, r.score) for r in cleaning.bm25_corpus(page, "red fish", 0.0).collect()} == want
    assert cleaning.bm25_corpus(page.limit(0), "red").count() == 0 and cleaning.bm25_corpus(page, "").filter("score > 0").count() == 0


def test_corpus_bm25_shuffles_no_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    plan = pages.select("page_id", B.query_counts(B.page_blocks("html"), ["a"]).alias("blocks"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("error", [0.01, 0.05])
def test_sketch_error_is_as_stated(spark, error):
    rnd = random.Random(4)
    times = [rnd.lognormvariate(0, 2) for _ in range(4000)] + [0.0] * 5 + [None] * 7
    rows = spark.createDataFrame([(k % 3, "x", t) for k, t in enumerate(times)], "part int, lane string, elapsed_s double").withColumn("case", F.lit("c"))
    parts = [races.latency_sketch(rows.filter(F.col("part") == k), error=error) for k in range(3)]
    shares = (0.01, 0.5, 0.95, 0.99, 1.0)
    got = races.sketch_percentiles(races.merge_sketches(*parts), shares, error).first()
    exact = sorted(t * 1000 for t in times if t is not None)
    assert got.n == len(exact)
    for p in shares:
        true = exact[-(-int(round(p * 100)) * len(exact) // 100) - 1]
        assert abs(got[f"p{round(100 * p)}_ms"] - true) <= error * true + 1e-9
    assert races.merge_sketches(*parts).count() < 2000


def test_a_busy_second_is_cut_into_pieces(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice("ab"), 1_700_000_000 + (0 if k < 1500 else k), k, rnd.choice(["easyget", "jina"]), rnd.choice([1, 1, -1])) for k in range(2000)]
    events = spark.createDataFrame(rows, "host string, ts long, event_id long, lane string, delta int").withColumn("ts", F.timestamp_seconds("ts"))

    def entries(piece):
        parts = learning.block_descriptions(events, piece=piece).collect()
        return sorted((r.host, r.bucket, r.d, r.n, r.updated) for r in parts)

    assert entries(4) == entries(1 << 20)
    state = {}
    for host, _, _, lane, delta in sorted(rows, key=lambda r: (r[1], r[2])):
        old, score = state.get(host, (None, 0))
        score = max(0, delta) if score <= 0 else max(0, score + delta) if old == lane else 1
        state[host] = (lane, score) if score else (None, 0)
    assert {r.cache_key: (r.decision, r.score) for r in learning.learn_scores(events).collect()} == {h: s for h, s in state.items() if s[1]}


def test_a_million_events_of_one_second(spark):
    events = spark.range(1_000_000).select(
        F.lit("h").alias("host"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"), F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, "jina").otherwise("easyget").alias("lane"), F.lit(1).alias("delta"))
    got = learning.learn_scores(events).first()
    assert got.events == 1_000_000 and got.decision == "jina" and got.score == 1
