"""Text stability as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stability import text_stability
from ..sources.versions import Versions
from .folds import Batch, run_folds

VERDICT = ("page_key long, reason string, event_id long, wait_ms double, check_count long, stable_count long, "
           "zero_count long, connectivity_wait_count long, initial_length long, final_length long, growth_ratio double")
JUDGED = "page_key long, us long"


def text_stability_stream(obs: DataFrame, location: str, checkpoint: str, watermark: str = "10 minutes", min_chars: int = 500,
                          delta: int = 100, stable_n: int = 3, zero_n: int = 12, timeout_ms: int = 5000,
                          forget_ms: int | None = None) -> DataFrame:
    """W4 on a stream (``page_key, ts, event_id, text_len``, optionally ``text``), drained; returns the verdicts.

    A page's observations wait until the watermark has passed them, and stay until a rule ends the wait, so the result
    does not depend on how rows fall into micro-batches. Later rows of a judged page are ignored; with ``forget_ms`` only
    until the watermark has moved on by that much.
    """
    limits = dict(min_chars=min_chars, delta=delta, stable_n=stable_n, zero_n=zero_n, timeout_ms=timeout_ms)
    kept = ["page_key", "ts", "event_id", "text_len", *(["text"] if "text" in obs.columns else [])]
    rows = obs.select(F.col("page_key").cast("long").alias("page_key"), *kept[1:])

    def fold(batch: Batch) -> None:
        judged = batch.latest("judged", JUDGED, ["page_key"])
        if forget_ms is not None:
            judged = judged.filter(F.col("us") + forget_ms * 1000 > batch.mark)
        open_rows = batch.rows.join(judged.select("page_key"), "page_key", "left_anti")
        found = batch.add("verdicts", text_stability(batch.final(open_rows), **limits), VERDICT)
        marked = found.select("page_key", F.lit(batch.mark).alias("us"), F.lit(False).alias("removed"))
        batch.add("judged", marked, f"{JUDGED}, removed boolean")
        batch.hold(open_rows.join(found.select("page_key"), "page_key", "left_anti").select(*kept))

    run_folds(rows, location, checkpoint, fold, watermark, compact={"judged": (JUDGED, ["page_key"])})
    return verdicts(obs.sparkSession, location)


def verdicts(spark: SparkSession, location: str) -> DataFrame:
    """The verdicts that the stream has given so far."""
    return Versions(spark, location).rows("verdicts", VERDICT).drop("_seq")
