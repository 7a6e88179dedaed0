"""Requests, lane plans and batch results (SRC1, R3, R6, R7, R8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import WS, col, str_array
from ..rules import CRAWL_TYPES, MODES


def url_requests(df: DataFrame, urls_col: str = "urls") -> DataFrame:
    """SRC1: one row per requested URL with its position.

    ``invalid_reason`` names what is wrong with the row; ``request_rejected`` tells whether the request as a
    whole is refused (one blank URL refuses all of it).
    """
    def blank(u: Column) -> Column:
        return u.isNull() | u.rlike(f"^{WS}*$")

    bad_mode = ~F.coalesce(F.col("mode"), F.lit("normal")).isin(*MODES)
    bad_type = ~F.coalesce(F.col("crawl_type"), F.lit("auto")).isin(*CRAWL_TYPES)
    empty = F.coalesce(F.size(F.col(urls_col)), F.lit(0)) <= 0
    rejected = empty | bad_mode | bad_type | F.exists(F.col(urls_col), blank)
    keep = [c for c in df.columns if c != urls_col]
    rows = df.select(*keep, F.coalesce(rejected, F.lit(True)).alias("request_rejected"),
                     F.posexplode_outer(urls_col).alias("pos", "url"))
    reason = (F.when(F.col("pos").isNull(), "empty_urls").when(blank(F.col("url")), "blank_url")
              .when(bad_mode, "bad_mode").when(bad_type, "bad_crawl_type"))
    return rows.withColumn("invalid_reason", reason)


def lanes_for(mode, crawl_type, recommended=None) -> Column:
    """Lanes to try, in order: fixed by mode, in ``normal`` mode by the recommended route, else a race."""
    race = str_array(["easyget", "playwright", "jina"])
    normal = race
    if recommended is not None:
        hint = col(recommended)
        normal = (F.when(hint.isin("pdf", "easyget", "playwright", "jina"), F.array(hint))
                  .when(hint == "blocked", str_array([])).otherwise(race))
    mode = F.coalesce(col(mode), F.lit("normal"))
    return (F.when(col(crawl_type) == "pdf", str_array(["pdf"]))
            .when(mode == "fast", str_array(["easyget"]))
            .when(mode == "playwright", str_array(["playwright"]))
            .when(mode == "jina", str_array(["jina"]))
            .when(mode == "no_jina", str_array(["easyget", "playwright"]))
            .otherwise(normal))


def lane_plan(requests: DataFrame, recommended: str | None = None) -> DataFrame:
    """One row per lane to try; a request with nothing to try keeps one row with a NULL lane."""
    lanes = lanes_for("mode", "crawl_type", recommended)
    return requests.select("*", F.posexplode_outer(lanes).alias("lane_no", "lane"))


def batch_summary(requests: DataFrame, results: DataFrame, key: str = "request_id",
                  batch: str = "batch_id") -> DataFrame:
    """Totals per batch; a request without a result counts as failed."""
    done = results.select(key, F.col("success").alias("_ok"), F.col("elapsed_s").alias("_s"), F.lit(True).alias("_hit"))
    joined = requests.select(key, batch).join(done, key, "left")
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    return joined.groupBy(batch).agg(
        F.count("*").alias("total_urls"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
        F.count_if(F.col("_hit").isNull()).alias("missing"),
        F.coalesce(F.max("_s"), F.lit(0.0)).alias("max_time"),
        F.round(F.coalesce(F.sum("_s"), F.lit(0.0)), 3).alias("total_time"))


def batch_code(results: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Code 1 with a partial-failure message when any result of the batch failed; a NULL outcome is a failure."""
    code = F.max(F.when(F.coalesce(F.col("success"), F.lit(False)), 0).otherwise(1))
    return (results.groupBy(batch).agg(code.alias("code"))
            .withColumn("msg", F.when(F.col("code") == 1, "部分URL爬取失败").otherwise("爬取完成")))


def outcomes(results: DataFrame) -> DataFrame:
    """R8 as one column: ``ok`` or ``failed``; a NULL outcome is a failure."""
    return results.withColumn("outcome", F.when(F.coalesce(F.col("success"), F.lit(False)), "ok").otherwise("failed"))


def split_outcomes(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ok, failed); a NULL outcome is a failure."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return results.filter(ok), results.filter(~ok)
