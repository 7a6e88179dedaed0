"""Text stability of a loading page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import contains_any
from ..rules import CONNECTIVITY_PHRASES

# Order in which the rules are tried (fixed).
REASONS = ("zero_text_threshold", "stable", "forced_timeout")
DEFAULTS = dict(min_chars=500, delta=100, stable_n=3, zero_n=12, timeout_ms=5000)


def _error_state(obs: DataFrame) -> Column:
    return F.coalesce(contains_any("text", CONNECTIVITY_PHRASES), F.lit(False)) if "text" in obs.columns else F.lit(False)


def text_stability(obs: DataFrame, min_chars: int = 500, delta: int = 100, stable_n: int = 3, zero_n: int = 12,
                   timeout_ms: int = 5000, key: str = "page_key") -> DataFrame:
    """First observation that ends the wait for a page, with the counters at that point.

    The first observation is the starting length, the first check never counts as stable, and a check in
    error state resets the stable run without being judged. A wait cannot outlast ``timeout_ms``: per page only
    the observations up to the first one past it are kept (the latter found by a partial aggregate), so the
    windows see a bounded number of rows however often a page was observed.
    """
    base = obs.select(key, "ts", "event_id", F.col("text_len").cast("long").alias("len"), _error_state(obs).alias("err"))
    starts = base.groupBy(key).agg(F.min("ts").alias("start"))
    timed = base.join(starts, key).withColumn("wait_ms", (_micros("ts") - _micros("start")) / 1000)
    inside = timed.filter(F.col("wait_ms") <= timeout_ms)
    # A row past the timeout ends the wait unless it is in error state, so the first such row without error
    # suffices, plus the count of error rows before it.
    late = timed.filter(F.col("wait_ms") > timeout_ms)
    cols = [c for c in timed.columns if c != key]
    at = F.struct("ts", "event_id")
    end = late.groupBy(key).agg(
        F.min_by(F.when(~F.col("err"), F.struct(*cols)), F.when(~F.col("err"), at)).alias("r"))
    last = end.filter(F.col("r").isNotNull()).select(key, "r.*")
    bad = (late.filter("err").join(last.select(key, F.struct("ts", "event_id").alias("end_at")), key)
           .filter(F.struct("ts", "event_id") < F.col("end_at"))
           .groupBy(key).agg(F.count("*").alias("skipped"),
                             F.max_by("len", F.struct("ts", "event_id")).alias("skipped_len")))
    last = last.join(bad, key, "left")
    rows = inside.withColumn("skipped", F.lit(None).cast("long")).withColumn("skipped_len", F.lit(None).cast("long"))
    rows = rows.unionByName(last)

    w = Window.partitionBy(key).orderBy("ts", "event_id")
    skipped = F.coalesce(F.col("skipped"), F.lit(0))
    first = (rows.withColumn("seq", F.row_number().over(w) - 1)
             .withColumn("prev", F.coalesce("skipped_len", F.lag("len").over(w)))
             .withColumn("initial_len", F.first("len").over(w))
             .withColumn("check_no", F.col("seq") + skipped))
    small = (F.col("check_no") >= 2) & ~F.col("err") & (F.abs(F.col("len") - F.col("prev")) <= delta) & (F.col("len") > 0)
    seen = (F.col("seq") == 0) | ~F.col("err")
    flagged = (first.withColumn("small", F.coalesce(small, F.lit(False)))
               .withColumn("n_seen", F.sum(seen.cast("long")).over(w))
               .withColumn("errors", F.sum(((F.col("seq") > 0) & F.col("err")).cast("long") + skipped).over(w)))
    # A run of small changes ends at any other check; skipped error rows end it just before this row.
    broken = F.when(~F.col("small"), F.col("check_no")).when(skipped > 0, F.col("check_no") - 1)
    nonzero = F.when(seen & (F.col("len") > 0), F.col("n_seen"))
    counted = (flagged.withColumn("stable_count", F.col("check_no") - F.coalesce(F.max(broken).over(w), F.lit(0)))
               .withColumn("zero_count", F.col("n_seen") - F.coalesce(F.max(nonzero).over(w), F.lit(0))))
    tests = {"zero_text_threshold": F.col("zero_count") >= zero_n,
             "stable": (F.col("len") >= min_chars) & (F.col("stable_count") >= stable_n),
             "forced_timeout": F.col("wait_ms") > timeout_ms}
    reason = F.coalesce(*[F.when(tests[name], name) for name in REASONS])
    judged = counted.filter((F.col("seq") > 0) & ~F.col("err")).withColumn("reason", reason)
    growth = (F.col("v.len") - F.col("v.initial_len")) / F.greatest(F.col("v.initial_len"), F.lit(1))
    verdict = judged.filter(F.col("reason").isNotNull()).groupBy(key).agg(
        F.min_by(F.struct("reason", "ts", "event_id", "check_no", "stable_count", "zero_count", "errors", "initial_len",
                          "len", "wait_ms"), F.struct("ts", "event_id")).alias("v"))
    return verdict.select(
        key, F.col("v.reason").alias("reason"), F.col("v.event_id").alias("event_id"), F.col("v.wait_ms").alias("wait_ms"),
        F.col("v.check_no").alias("check_count"), F.col("v.stable_count").alias("stable_count"),
        F.col("v.zero_count").alias("zero_count"), F.col("v.errors").alias("connectivity_wait_count"),
        F.col("v.initial_len").alias("initial_length"), F.col("v.len").alias("final_length"),
        F.round(growth, 6).alias("growth_ratio"))


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))
