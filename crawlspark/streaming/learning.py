"""Learned scores as a stream (L2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.learning import fold_scores
from ..sources.versions import Versions
from .folds import Batch, run_folds

STATE = "cache_key string, decision string, score int, events long, updated timestamp"


def learn_scores_stream(events: DataFrame, location: str, checkpoint: str, watermark: str = "10 minutes") -> DataFrame:
    """L2: L1 on a stream (``host, ts, event_id, lane, delta``), drained; returns the learned state.

    Each micro-batch folds the events that the watermark has passed onto the entries of their hosts and adds a delta of
    those entries; a host whose entry ends is removed. Events that come after the watermark are kept in the table ``late``.
    """
    rows = events.select("host", "ts", "event_id", "lane", "delta")

    def fold(batch: Batch) -> None:
        due = batch.final(batch.rows)
        old = batch.latest("state", STATE, ["cache_key"])
        old = old.join(due.select("host").distinct(), old["cache_key"] == due["host"], "left_semi")
        entries = fold_scores(due, old).withColumn("removed", F.coalesce(F.col("score"), F.lit(0)) <= 0)
        batch.add("state", entries, f"{STATE}, removed boolean")
        batch.hold(batch.waiting(batch.rows))

    run_folds(rows, location, checkpoint, fold, watermark, compact={"state": (STATE, ["cache_key"])})
    return learned_state(events.sparkSession, location)


def learned_state(spark: SparkSession, location: str) -> DataFrame:
    """The entries that the stream has learned so far."""
    return Versions(spark, location).latest("state", STATE, ["cache_key"])
