"""Races between fetch lanes (Q7, Q9, R4, R5, W7) - all partial aggregates keyed by request."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions.text import failure_markdown, visible_text
from ..rules import LANES

ERROR_COLUMNS = {"easyget": "easyget_error", "playwright": "playwright_error", "jina": "jina_error", "pdf": "pdf_error"}
OTHER = "other"  # lanes that are not in LANES, and a missing lane


def _lane_order() -> Column:
    order = F.lit(len(LANES))
    for i, lane in enumerate(LANES):
        order = F.when(F.col("lane") == lane, i).otherwise(order)
    return order


def apply_health(attempts: DataFrame, min_len: int = 150, facts: str | None = None) -> DataFrame:
    """Q7: judge every attempt by its Markdown (else the visible text of its HTML).

    ``facts`` names a column of :func:`~crawlspark.functions.quality.health_facts` to judge by instead, for attempts whose
    texts were looked at before: where they are stored once, neither they nor the work on them grows with the attempts.

    An unhealthy attempt fails; the message goes to the error column of its lane, to all of them when the
    lane is unknown, and never replaces an earlier message.
    """
    if facts is None:
        text = F.when(F.coalesce(F.col("markdown"), F.lit("")) != "", F.col("markdown")).otherwise(
            visible_text(F.coalesce(F.col("html"), F.lit(""))))
        judged = attempts.withColumn("health", Q.content_health(text, F.col("status_code"), min_len))
    else:
        judged = attempts.withColumn("health", Q.health_of(facts, F.col("status_code"), min_len))
    bad = ~F.col("health.ok")
    message = F.concat(F.lit("内容健康检测失败: "), F.col("health.reason"))
    known = F.coalesce(F.col("lane").isin(*ERROR_COLUMNS), F.lit(False))
    out = judged.withColumn("success", F.coalesce(F.col("success"), F.lit(False)) & ~bad)
    for lane, name in ERROR_COLUMNS.items():
        old = F.col(name) if name in attempts.columns else F.lit(None).cast("string")
        mine = bad & (F.coalesce(F.col("lane") == lane, F.lit(False)) | ~known)
        out = out.withColumn(name, F.when(F.coalesce(old, F.lit("")) != "", old).when(mine, message).otherwise(old))
    return out


def failure_cause(attempts: DataFrame, facts: str | None = None) -> DataFrame:
    """Q9: cause of every failed attempt; ``facts`` names a column of :func:`~crawlspark.functions.quality.cause_in_text`."""
    own = F.coalesce(*[F.when(F.col("lane") == lane, F.col(name)) for lane, name in ERROR_COLUMNS.items() if name in attempts.columns])
    n = F.col("text_length") if "text_length" in attempts.columns else None
    by_text = facts or Q.cause_in_text("markdown", visible_text(F.coalesce(F.col("html"), F.lit(""))))
    cause = Q.lane_failure_cause("lane", own, by_text, "status_code", n)
    return attempts.filter(~F.coalesce(F.col("success"), F.lit(False))).withColumn("cause", cause)


def with_causes(attempts: DataFrame, facts: str | None = None) -> DataFrame:
    """Every attempt with ``cause``, NULL where it succeeded (Q9 as a column)."""
    failed = failure_cause(attempts.withColumn("_ok", F.col("success")).withColumn("success", F.lit(False)), facts)
    bad = ~F.coalesce(F.col("_ok"), F.lit(False))
    return failed.withColumn("success", F.col("_ok")).withColumn("cause", F.when(bad, F.col("cause"))).drop("_ok")


def resolved_requests(attempts: DataFrame) -> DataFrame:
    """One row per request: success, and the known elapsed time of the fastest success, else the longest of all. One pass."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    by_time = F.struct(F.col("elapsed_s").isNull(), F.col("elapsed_s"), _lane_order(), F.col("attempt_id"))
    agg = attempts.groupBy("request_id").agg(
        F.bool_or(ok).alias("success"), F.max("elapsed_s").alias("longest"),
        F.min_by(F.when(ok, F.struct("elapsed_s")), F.when(ok, by_time)).alias("won"))
    return agg.select("request_id", "success", F.coalesce("won.elapsed_s", "longest").alias("elapsed_s"))


def race_winner(attempts: DataFrame, policy: str = "first_success", carry: tuple = ("url", "host")) -> DataFrame:
    """One winning attempt per request; requests without success have none.

    ``first_success`` takes the fastest success (ties: easyget, jina, playwright); an unknown
    time comes after all known ones. ``first_finisher`` takes the
    first finisher if it succeeded, else the success with the best fixed priority.
    """
    row = F.struct("attempt_id", "lane", "success", "elapsed_s", "status_code", "ts", *carry)
    by_time = F.struct(F.col("elapsed_s").isNull(), F.col("elapsed_s"), _lane_order(), F.col("attempt_id"))
    ok = F.coalesce(F.col("success"), F.lit(False))
    if policy == "first_success":
        agg = F.min_by(F.when(ok, row), F.when(ok, by_time))
        picked = attempts.groupBy("request_id").agg(agg.alias("w"))
    elif policy == "first_finisher":
        by_lane = F.struct(_lane_order(), F.col("elapsed_s").isNull(), F.col("elapsed_s"), F.col("attempt_id"))
        picked = attempts.groupBy("request_id").agg(
            F.min_by(row, by_time).alias("first"), F.min_by(F.when(ok, row), F.when(ok, by_lane)).alias("rest"))
        picked = picked.select("request_id", F.when(F.col("first.success"), F.col("first"))
                               .otherwise(F.col("rest")).alias("w"))
    else:
        raise ValueError(f"unknown race policy: {policy}")
    return picked.filter(F.col("w").isNotNull()).select("request_id", "w.*")


def race_failures(attempts: DataFrame) -> DataFrame:
    """Requests on which every lane failed, with the causes, a status and the failure body."""
    causes = {lane: F.max(F.when(F.col("lane") == lane, F.coalesce(F.col("cause"), F.lit("失败，未知原因"))))
              for lane in ERROR_COLUMNS}
    missing = "任务返回None（可能被取消或超时）"  # fixed value, as is the one above
    # The pdf lane is tried for some requests only, so its silence is no failure.
    errors = [(c if lane == "pdf" else F.coalesce(c, F.lit(missing))).alias(ERROR_COLUMNS[lane]) for lane, c in causes.items()]
    agg = attempts.groupBy("request_id").agg(
        F.min("url").alias("url"), F.min("host").alias("host"), F.max("ts").alias("ts"),
        F.bool_or(F.coalesce(F.col("success"), F.lit(False))).alias("any_ok"),
        *errors,
        F.max(F.when(F.col("lane") == "playwright", F.col("status_code"))).alias("_browser"),
        F.max(F.when(F.col("lane") == "jina", F.col("status_code"))).alias("_reader"),
        F.max("elapsed_s").alias("elapsed_s"))
    lost = agg.filter(~F.col("any_ok"))
    status = Q.resolved_status("_browser", "playwright_error", "_reader")
    return lost.select(
        "request_id", "url", "host", "ts", *ERROR_COLUMNS.values(), status.alias("status_code"), "elapsed_s",
        failure_markdown("url", "easyget_error", "playwright_error", "jina_error", "pdf_error").alias("markdown"),
        F.lit("blocked").alias("decision"))


def latency_table(attempts: DataFrame, case: str = "case") -> DataFrame:
    """Per case, one column group per lane: count, success rate, mean, median, 95th percentile, maximum (ms).

    Rows are first counted per distinct time, so a lane that holds a third of all rows reaches its final task as a
    histogram. Times are taken as they are; only the figures are rounded. Lanes outside the list are ``other``.
    """
    lane = F.when(F.col("lane").isin(*LANES), F.col("lane")).otherwise(OTHER)
    hist = attempts.groupBy(case, lane.alias("lane"), (F.col("elapsed_s") * 1000).alias("ms")).agg(
        F.count("*").alias("n"), F.count_if("success").alias("n_ok"))
    timed = F.when(F.col("ms").isNotNull(), F.col("n"))

    def pct(p: float) -> Column:
        return F.percentile("ms", p, F.col("n"))

    table = hist.groupBy(case).pivot("lane", [*LANES, OTHER]).agg(
        F.sum("n").alias("n"),
        F.round(F.sum("n_ok") / F.sum("n"), 6).alias("success_rate"),
        F.round(F.sum(F.col("ms") * F.col("n")) / F.sum(timed), 4).alias("avg_ms"),
        F.round(pct(0.5), 4).alias("p50_ms"), F.round(pct(0.95), 4).alias("p95_ms"), F.round(F.max("ms"), 4).alias("max_ms"))
    return table.fillna(0, [f"{x}_n" for x in (*LANES, OTHER)])


SKETCH_ERROR = 0.01


def latency_sketch(attempts: DataFrame, case: str = "case", error: float = SKETCH_ERROR) -> DataFrame:
    """W7 as a mergeable sketch: per case and lane, counts of times in buckets that each span ``error`` either way.

    Bucket k holds the times from g**(k - 1) to g**k milliseconds, g = (1 + error) / (1 - error); times of zero or less
    have the bucket NULL. The buckets of a span of nine decades are about 1,000 at an error of 0.01, whatever the rows. Sketches of
    parts of the attempts are merged by :func:`merge_sketches`.
    """
    lane = F.when(F.col("lane").isin(*LANES), F.col("lane")).otherwise(OTHER)
    ms = F.col("elapsed_s") * 1000
    bucket = F.when(ms > 0, F.ceil(F.log(ms) / math.log((1 + error) / (1 - error))))
    return attempts.filter(ms.isNotNull()).groupBy(F.col(case).alias("case"), lane.alias("lane"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    both = reduce(DataFrame.unionByName, sketches)
    return both.groupBy("case", "lane", "bucket").agg(F.sum("n").alias("n"))


def sketch_percentiles(sketch: DataFrame, shares: tuple[float, ...] = (0.5, 0.95), error: float = SKETCH_ERROR) -> DataFrame:
    """case, lane, n and for each share the time at rank ceil(share * n), off by at most ``error`` of it."""
    g = (1 + error) / (1 - error)
    order = Window.partitionBy("case", "lane").orderBy(F.asc_nulls_first("bucket"))
    whole = Window.partitionBy("case", "lane")
    rows = sketch.withColumn("_upto", F.sum("n").over(order)).withColumn("_all", F.sum("n").over(whole))
    value = F.coalesce(F.lit(2.0) * F.pow(F.lit(g), F.col("bucket")) / (g + 1), F.lit(0.0))
    found = [F.min(F.when(F.col("_upto") >= F.ceil(F.lit(p) * F.col("_all")), value)).alias(f"p{round(100 * p)}_ms") for p in shares]
    return rows.groupBy("case", "lane").agg(F.sum("n").alias("n"), *found)


def visit_curve(attempts: DataFrame, key: str = "host") -> DataFrame:
    """Elapsed time by the n-th visit of a host (1, 2, 3, 4, 5+).

    Only the first four visits of a host need a rank, and a ranked limit is applied before the shuffle. The "5+" class
    is the histogram of all visits minus that of the first four (each of them gives a row for its own class and a
    negative one for "5+"): no host is ever sorted whole. Times are taken as they are.
    """
    from pyspark.sql import Window

    base = attempts.select(key, "ts", "attempt_id", (F.col("elapsed_s") * 1000).alias("ms"))
    order = Window.partitionBy(key).orderBy("ts", "attempt_id")
    early = base.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= 4)
    both = F.array(F.struct(F.col("n").cast("string").alias("visit"), F.lit(1).alias("c")),
                   F.struct(F.lit("5+").alias("visit"), F.lit(-1).alias("c")))
    signed = early.select("ms", F.inline(both)).unionByName(base.select("ms", F.lit("5+").alias("visit"), F.lit(1).alias("c")))
    hist = signed.groupBy("visit", "ms").agg(F.sum("c").alias("c")).filter(F.col("c") > 0)
    timed = F.when(F.col("ms").isNotNull(), F.col("c"))
    return hist.groupBy("visit").agg(
        F.sum("c").alias("visits"), F.round(F.sum(F.col("ms") * F.col("c")) / F.sum(timed), 4).alias("avg_ms"),
        F.round(F.percentile("ms", 0.5, F.col("c")), 4).alias("p50_ms"))
