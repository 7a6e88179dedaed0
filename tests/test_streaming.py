"""Streams give the batch result, however rows fall into micro-batches; late rows are dropped and counted."""

import random

from pyspark.sql import functions as F

from crawlspark.operators import learning, stability
from crawlspark.session import shared_dir
from crawlspark.sources.readers import attempt_stream
from crawlspark.sources.versions import Versions
from crawlspark.streaming import folds
from crawlspark.streaming import learning as stream_learning
from crawlspark.streaming import progress
from crawlspark.streaming import stability as stream_stability

ATTEMPT = "attempt_id long, request_id long, ts timestamp_ntz, url string, host string, lane string, success boolean, status_code int, elapsed_s double"


def attempts(spark, n=400, seed=3):
    rnd = random.Random(seed)
    rows = [(i, i // 3, 1_700_000_000 + i * 20, "http://h/x", rnd.choice(["a.org", "a.org", "b.org", "c.org"]),
             rnd.choice(["easyget", "playwright", "jina"]), rnd.random() < 0.7, 200, 0.5) for i in range(n)]
    df = spark.createDataFrame(rows, ATTEMPT.replace("ts timestamp_ntz", "ts long"))
    return df.withColumn("ts", F.timestamp_seconds("ts").cast("timestamp_ntz"))


def landed(spark, df, cuts, key="attempt_id"):
    """One file per slice of ids, written in order."""
    place = shared_dir(spark, "landing")
    for lo, hi in zip(cuts, cuts[1:]):
        df.filter(F.col(key).between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(place)
    return place


def state_of(df):
    return {r.cache_key: (r.decision, r.score) for r in df.collect()}


def test_learned_scores(spark):
    df = attempts(spark)
    last = 1_700_000_000 + 399 * 20 - 60
    done = df.filter(F.unix_seconds(F.col("ts").cast("timestamp")) < last)
    want = state_of(learning.learn_scores(learning.attempt_events(done)))
    place, base = landed(spark, df, [0, 150, 290, 400]), shared_dir(spark, "t-learn")
    events = learning.attempt_events(attempt_stream(spark, place, files_per_trigger=1))
    got = stream_learning.learn_scores_stream(events, base + "/s", base + "/c", watermark="1 minute")
    assert state_of(got) == want


def test_streams_need_no_state_store_setting(spark):
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_a_restarted_stream_goes_on_and_counts_late_rows(spark):
    df = attempts(spark, 300)
    place, base = landed(spark, df, [0, 100]), shared_dir(spark, "t-restart")

    def run():
        events = learning.attempt_events(attempt_stream(spark, place, files_per_trigger=1))
        return events, stream_learning.learn_scores_stream(events, base + "/s", base + "/c", watermark="1 minute")

    run()
    before = Versions(spark, base + "/s").current()
    run()  # nothing new
    assert Versions(spark, base + "/s").current() == before
    df.filter("attempt_id >= 100").coalesce(1).write.mode("append").parquet(place)
    late = df.filter("attempt_id < 7").withColumn("attempt_id", F.col("attempt_id") + 1000)
    late.coalesce(1).write.mode("append").parquet(place)
    events, got = run()
    final = df.filter(F.unix_seconds(F.col("ts").cast("timestamp")) < 1_700_000_000 + 299 * 20 - 60)
    assert state_of(got) == state_of(learning.learn_scores(learning.attempt_events(final)))
    assert sorted(r.event_id for r in folds.late_rows(events.select("host", "ts", "event_id", "lane", "delta"), base + "/s").collect()) == list(range(1000, 1007))


def test_a_batch_that_runs_again_changes_nothing(spark):
    df, base = attempts(spark, 120), shared_dir(spark, "t-again")
    place = landed(spark, df, [0, 60, 120])
    stream = learning.attempt_events(attempt_stream(spark, place, files_per_trigger=1))
    first = state_of(stream_learning.learn_scores_stream(stream, base + "/s", base + "/c", "1 minute"))
    again = state_of(stream_learning.learn_scores_stream(stream, base + "/s", base + "/other", "1 minute"))  # from batch 0
    assert again == first


def test_text_stability(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 5), 1_700_000_000_000 + i * 300, i, rnd.choice([0, 400, 600, 610, 620, 900]),
             "We'll keep retrying" if rnd.random() < 0.1 else "body") for i in range(600)]
    obs = spark.createDataFrame(rows, "page_key long, ms long, event_id long, text_len long, text string").select(
        "page_key", F.timestamp_millis("ms").alias("ts"), "event_id", "text_len", "text")
    limits = dict(min_chars=500, delta=30, stable_n=3, zero_n=3, timeout_ms=60_000)
    want = {tuple(r) for r in stability.text_stability(obs, **limits).collect()}
    assert len(want) == 6
    for cuts in ([0, 200, 400, 600], [0, 20, 21, 600]):
        place, base = landed(spark, obs, cuts, "event_id"), shared_dir(spark, "t-stable")
        stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(place)
        got = stream_stability.text_stability_stream(stream, base + "/s", base + "/c", "1 second", **limits)
        assert {tuple(r) for r in got.collect()} == want


def test_judged_pages_are_forgotten_if_asked(spark):
    rows = [(1, 1000 * i, i, 600) for i in range(6)] + [(1, 100_000 + 1000 * i, 100 + i, 700) for i in range(6)] + [(2, 300_000, 999, 1)]
    obs = spark.createDataFrame(rows, "page_key long, ms long, event_id long, text_len long").select(
        "page_key", F.timestamp_millis("ms").alias("ts"), "event_id", "text_len")
    place = landed(spark, obs, [0, 50, 200, 1000], "event_id")
    for forget, want in ((None, [4]), (5_000, [4, 104])):
        base = shared_dir(spark, "t-forget")
        stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(place)
        got = stream_stability.text_stability_stream(stream, base + "/s", base + "/c", "0 seconds", forget_ms=forget)
        assert sorted(r.event_id for r in got.collect()) == want


def test_timeout_bound_keeps_late_error_rows_in_the_count(spark):
    rows = [(1, 0, 0, 100, "b"), (1, 1000, 1, 300, "b"), (1, 9000, 2, 305, "We'll keep retrying"), (1, 9500, 3, 310, "We'll keep retrying"),
            (1, 9900, 4, 312, "b"), (1, 9999, 5, 900, "b")]
    obs = spark.createDataFrame(rows, "page_key long, ms long, event_id long, text_len long, text string").select(
        "page_key", F.timestamp_millis("ms").alias("ts"), "event_id", "text_len", "text")
    limits = dict(min_chars=500, delta=30, stable_n=3, zero_n=3, timeout_ms=5000)
    assert [tuple(r) for r in stability.text_stability(obs, **limits).collect()] == [
        (1, "forced_timeout", 4, 9900.0, 4, 1, 0, 2, 100, 312, 2.12)]


def test_progress_and_late_rows(spark):
    df = attempts(spark, 360)
    late = df.filter("attempt_id < 5").withColumn("attempt_id", F.col("attempt_id") + 1000)
    place = landed(spark, df, [0, 180, 360])
    late.coalesce(1).write.mode("append").parquet(place)
    stream = progress.stream_progress(attempt_stream(spark, place, files_per_trigger=1), "10 minutes", "1 minute")
    base = shared_dir(spark, "t-progress")
    q = (stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", base + "/c")
         .trigger(availableNow=True).start(base + "/o"))
    q.awaitTermination()
    dropped = sum(o.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for o in p["stateOperators"])
    got = spark.read.parquet(base + "/o").agg(F.sum("started"), F.sum(F.col("done") + F.col("failed"))).first()
    end = 1_700_000_000 + 359 * 20 - 60
    closed = df.filter((F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 600) + 1) * 600 <= end).count()
    assert got[0] == got[1] == closed and dropped > 0


def test_running_totals(spark):
    place = landed(spark, attempts(spark, 90), [0, 30, 60, 90])
    base = shared_dir(spark, "t-totals")
    progress.running_totals(attempt_stream(spark, place, files_per_trigger=1), base + "/totals", base + "/c")
    got = spark.read.parquet(base + "/totals")
    assert got.select("batch").distinct().count() == 3 and got.agg(F.sum("started")).first()[0] == 90


# Golden traces: lengths observed every second ("x" in error state), then reason, place, checks, stable, zero, errors.
STABILITY = [
    ("0 600 600 600 600", ("stable", 4, 4, 3, 0, 0)), ("600 600 600", None), ("600 600 600 600 600", ("stable", 4, 4, 3, 0, 0)),
    ("0 0 0", ("zero_text_threshold", 2, 2, 0, 3, 0)), ("0 x 0 0", ("zero_text_threshold", 3, 3, 0, 3, 1)),
    ("600 610 620 x 625 630 635 640", ("stable", 6, 6, 3, 0, 1)), ("400 410 420 430 440", None),
    ("100 200 300 400 500 600 700 800 900 999 100 200", ("forced_timeout", 11, 11, 0, 0, 0)), ("0 5 0 5 0 0 0", ("zero_text_threshold", 6, 6, 0, 3, 0)),
]


def test_golden_stability_traces(spark):
    limits = dict(min_chars=500, delta=30, stable_n=3, zero_n=3, timeout_ms=10_000)
    rows, want = [], {}
    for key, (trace, verdict) in enumerate(STABILITY):
        last = 0
        for i, x in enumerate(trace.split()):
            last = last if x == "x" else int(x)
            rows.append((key, 1_700_000_000_000 + i * 1000, i, last, "We'll keep retrying" if x == "x" else "body"))
        if verdict:
            want[key] = verdict
    obs = spark.createDataFrame(rows, "page_key long, ms long, event_id long, text_len long, text string").select(
        "page_key", F.timestamp_millis("ms").alias("ts"), "event_id", "text_len", "text")
    got = {r.page_key: (r.reason, r.event_id, r.check_count, r.stable_count, r.zero_count, r.connectivity_wait_count)
           for r in stability.text_stability(obs, **limits).collect()}
    assert got == want


def test_closed_landing_gives_the_whole_answer(spark):
    df = attempts(spark, 300)
    place = landed(spark, df, [0, 300])
    progress.close_landing(spark, place)
    got = progress.run_to_files(progress.stream_progress(attempt_stream(spark, place)), "t-closed")
    assert got.agg(F.sum("started")).first()[0] == 300
