"""Candidate endpoints (W1-W3) and file inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import any_of, col
from ..rules import SPECIAL_ENDPOINTS


def usage_rollup(uses: DataFrame) -> DataFrame:
    """Last use (epoch seconds) and number of uses per endpoint."""
    return uses.groupBy("endpoint_id").agg(F.max(F.unix_timestamp("ts")).alias("last_used"), F.count("*").alias("uses"))


def eligible_endpoints(endpoints: DataFrame, current=None, excluded: DataFrame | None = None,
                       keywords: tuple = (), special: tuple = SPECIAL_ENDPOINTS) -> DataFrame:
    """Measured endpoints other than the current one (a missing name is no reason to drop one), none of the special names or excluded keywords."""
    out = endpoints.filter(F.col("delay_ms") > 0)
    if current is not None:
        out = out.filter(F.col("endpoint_id") != F.lit(current))
    if "name" in endpoints.columns:
        out = out.filter(~F.coalesce(F.col("name").isin(*special) | any_of(F.col("name").contains(k) for k in keywords), F.lit(False)))
    if excluded is not None:
        out = out.join(excluded.select("endpoint_id").distinct(), "endpoint_id", "left_anti")
    return out


def candidate_scores(endpoints: DataFrame, usage: DataFrame, now, weight: float = 0.7, cooldown: int = 300,
                     k: int = 1, seed: int = 0) -> DataFrame:
    """Weighted score of delay and idle time, the ``k`` best of each group, and a seeded pick among them.

    The pick hashes (seed, endpoint), so it is spread like a draw but repeats on a re-run.
    """
    spread = endpoints.groupBy("grp").agg(F.min("delay_ms").alias("_min"), F.max("delay_ms").alias("_max"))
    idle = F.greatest(F.lit(0), col(now) - F.col("last_used"))
    recency = (F.when(F.coalesce(F.col("last_used"), F.lit(0)) == 0, F.lit(1.0))
               .otherwise(F.least(F.lit(1.0), idle / F.lit(float(max(1, cooldown))))))
    delay = (F.col("_max") - F.col("delay_ms")) / F.greatest(F.lit(1), F.col("_max") - F.col("_min"))
    score = F.round(weight * delay + (1.0 - weight) * recency, 9)
    scored = (endpoints.join(spread, "grp").join(usage.select("endpoint_id", "last_used"), "endpoint_id", "left")
              .select("grp", "endpoint_id", "delay_ms", "last_used", score.alias("score")))
    best = Window.partitionBy("grp").orderBy(F.desc("score"), "endpoint_id")
    top = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= max(1, k))
    draw = F.xxhash64(F.lit(seed), F.col("endpoint_id"))
    first = F.min(F.struct(draw, "endpoint_id")).over(Window.partitionBy("grp"))["endpoint_id"]
    return top.withColumn("picked", F.col("endpoint_id") == first)


def file_inventory(files: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """One row of totals, and the newest files (a top-k, so no global sort)."""
    totals = files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"),
                       _mb(F.coalesce(F.sum("file_size"), F.lit(0))).alias("total_size_mb"))
    newest = (files.filter(F.col("download_time").isNotNull())
              .orderBy(F.desc("download_time"), "file_id").limit(top))
    return totals, newest


def _mb(c: Column) -> Column:
    return F.round(c / F.lit(1024.0 * 1024.0), 2)


def retention_split(files: DataFrame, now, max_age_h: float = 12) -> DataFrame:
    """Fate of each file - ``keep``, ``expire``, or ``invalid`` when its time cannot be read.

    Both ``expire`` and ``invalid`` leave the index; only expired files count as freed space.
    """
    when = F.col("download_time")
    if dict(files.dtypes)["download_time"] == "string":
        when = F.try_to_timestamp(when)
    cutoff = col(now) - F.make_interval(secs=F.lit(max_age_h * 3600))
    fate = F.when(when.isNull(), "invalid").when(when < cutoff, "expire").otherwise("keep")
    return files.withColumn("fate", fate).withColumn("removed", F.col("fate") != "keep")


def retention_summary(split: DataFrame) -> DataFrame:
    return split.groupBy("fate").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"),
                                     _mb(F.sum("file_size")).alias("mb"))
