import random

from pyspark.sql import functions as F

from crawlspark.operators import learning

LANES = ("easyget", "playwright", "jina", "blocked")


def make(seed, n, hosts):
    rnd = random.Random(seed)
    lanes = LANES[: rnd.choice((1, 2, 4))]
    return [(rnd.choice(hosts), rnd.randint(0, 3000), i, rnd.choice(lanes), rnd.choice((1, -1, -1, 1, 1))) for i in range(n)]


def frame(spark, events):
    return spark.createDataFrame(events, "host string, s long, event_id long, lane string, delta int").select(
        "host", F.timestamp_seconds("s").alias("ts"), "event_id", "lane", "delta")


def learned(df):
    return {r.cache_key: (r.decision, r.score) for r in df.collect()}


# Golden traces: events of one host in order, state before, state after.
TRACES = [
    ("+e", None, ("easyget", 1)), ("-e", None, None), ("-e +e", None, ("easyget", 1)), ("+e +e -e", None, ("easyget", 1)),
    ("+e -e", None, None), ("+e -e +j", None, ("jina", 1)), ("+e +e +j", None, ("jina", 1)), ("+e +e -j", None, ("jina", 1)),
    ("-e", ("easyget", 1), None), ("-e -e +p", ("easyget", 2), ("playwright", 1)), ("-j -j", ("easyget", 5), None),
    ("-j +j +j -j", ("easyget", 5), ("jina", 2)), ("+b +b +b", ("blocked", 2), ("blocked", 5)), ("", ("jina", 4), ("jina", 4)),
]
SHORT = {"e": "easyget", "j": "jina", "p": "playwright", "b": "blocked"}


def test_golden_traces(spark):
    events, start = [], []
    for k, (steps, before, _) in enumerate(TRACES):
        events += [(f"h{k}", i, i, SHORT[x[1]], 1 if x[0] == "+" else -1) for i, x in enumerate(steps.split())]
        if before:
            start.append((f"h{k}", *before))
    state = spark.createDataFrame(start, "cache_key string, decision string, score int")
    want = {f"h{k}": after for k, (_, _, after) in enumerate(TRACES) if after}
    for bucket, block in ((1, 3600), (1, 2), (2, 4), (1_000_000, 1)):
        assert learned(learning.learn_scores(frame(spark, events), state, bucket, block)) == want


def test_fold_does_not_depend_on_grouping_or_partitions(spark):
    """The description of a stretch is associative, so every way to cut the same events gives the same state."""
    hosts = [f"h{i}.org" for i in range(40)]
    state0 = spark.createDataFrame([(h, LANES[i % 4], 1 + i % 3) for i, h in enumerate(hosts) if i % 2],
                                   "cache_key string, decision string, score int")
    for seed in range(3):
        events = make(seed, 1500, hosts)
        one = learned(learning.learn_scores(frame(spark, events), state0, 1_000_000, 1))
        for bucket, block in ((1, 3600), (1, 30), (60, 60)):
            assert learned(learning.learn_scores(frame(spark, events).repartition(1 + seed * 3), state0, bucket, block)) == one


def test_folding_in_two_parts_is_folding_once(spark):
    hot = make(9, 4000, ["hot.org"] * 9 + ["cold.org"])
    cut = 1500
    first = learning.learn_scores(frame(spark, [e for e in hot if e[1] < cut])).select("cache_key", "decision", "score")
    both = learning.learn_scores(frame(spark, [e for e in hot if e[1] >= cut]), first)
    assert learned(both) == learned(learning.learn_scores(frame(spark, hot)))


def test_switch_resets_even_on_failure(spark):
    events = [("h", 1, 1, "easyget", 1), ("h", 2, 2, "easyget", 1), ("h", 3, 3, "jina", -1)]
    assert [(r.decision, r.score) for r in learning.learn_scores(frame(spark, events)).collect()] == [("jina", 1)]


def test_pdf_learning(spark):
    rows = [("http://n.org/a/pdfs/x1", t, t, t != 2) for t in range(1, 6)] + [("http://k.org/pdf/x", 1, 10, True)] * 4 + [("http://f.org/pdf/x", 1, 20, True)] * 2
    events = spark.createDataFrame(rows, "url string, s long, event_id long, success boolean").select(
        F.regexp_extract("url", "//([^/]+)", 1).alias("host"), "url", F.timestamp_seconds("s").alias("ts"), "event_id", "success")
    known = spark.createDataFrame([("k.org",)], "host string")
    got = {r.host: (r.success_count, r.learned) for r in learning.learn_pdf_hosts(events, known).collect()}
    assert got == {"n.org": (4, True), "k.org": (4, False), "f.org": (2, False)}
    assert [tuple(r) for r in learning.learn_pdf_paths(events, known).collect()] == [("n.org", "/a/pdfs/")]


def test_merge_and_cap(spark):
    a = spark.createDataFrame([("x", "jina", 1), ("y", "pdf", 2)], "cache_key string, decision string, score int")
    b = spark.createDataFrame([("y", "easyget", 9)], "cache_key string, decision string, score int")
    assert sorted(map(tuple, learning.merge_state(a, b).collect())) == [("x", "jina", 1), ("y", "easyget", 9)]
    s = spark.createDataFrame([(f"k{i}", i) for i in range(30)], "cache_key string, updated long")
    assert [r.cache_key for r in learning.cap_state(s, 3).collect()] == ["k29", "k28", "k27"]
