"""Progress totals of a stream of attempts (W10) and running streams to completion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.versions import Versions
from .folds import Batch, late_rows, run_folds

TOTALS = "window_start timestamp, lane string, started long, done long, failed long"


def stream_progress(attempts: DataFrame, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Started, done and failed attempts per event-time window and lane, emitted when a window closes."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return (attempts.withWatermark("ts", watermark).groupBy(F.window("ts", window), "lane")
            .agg(F.count("*").alias("started"), F.count_if(ok).alias("done"), F.count_if(~ok).alias("failed"))
            .select(F.col("window.start").alias("window_start"), "lane", "started", "done", "failed"))


def close_landing(spark: SparkSession, place: str, ahead: str = "1 day") -> None:
    """End a bounded landing: one more file repeats the newest row, ``ahead`` of it in time.

    It moves the watermark past everything before it, so that the windows and waits of all true rows close. It stays
    in a window of its own that never closes and so is in no result. Rows that come late after that are dropped and
    counted by Spark (``numRowsDroppedByWatermark``).
    """
    rows = spark.read.parquet(place)
    newest = rows.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {ahead}"))
    newest.select(*rows.columns).coalesce(1).write.mode("append").parquet(place)


def run_to_files(stream: DataFrame, purpose: str, mode: str = "append") -> DataFrame:
    """Drain the available input into a folder below the shared checkpoint folder and read it back.

    The file sink commits every micro-batch once, so a restarted query neither loses nor repeats rows.
    """
    spark: SparkSession = stream.sparkSession
    base = shared_dir(spark, purpose)
    query = (stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start(f"{base}/out"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def running_totals(stream: DataFrame, totals: str, checkpoint: str) -> None:
    """W10, per batch: one row of totals per micro-batch, written under its batch number (a repeat overwrites it)."""
    ok = F.coalesce(F.col("success"), F.lit(False))

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.groupBy("lane").agg(F.count("*").alias("started"), F.count_if(ok).alias("done"), F.count_if(~ok).alias("failed"))
         .write.mode("overwrite").parquet(f"{totals.rstrip('/')}/batch={batch_id}"))

    (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def progress_with_late(attempts: DataFrame, location: str, checkpoint: str, window: str = "1 hour",
                       watermark: str = "10 minutes") -> DataFrame:
    """W10 with late rows as data: started, done, failed of the rows in time, and ``late``, per window and lane.

    Every micro-batch adds a delta of sums; rows that came after the watermark are rows of the table ``late`` and are
    counted from there.
    """
    rows = attempts.select("ts", "lane", "success")
    ok = F.coalesce(F.col("success"), F.lit(False))

    def fold(batch: Batch) -> None:
        new = batch.rows.groupBy(F.window("ts", window)["start"].alias("window_start"), "lane").agg(
            F.count("*").alias("started"), F.count_if(ok).alias("done"), F.count_if(~ok).alias("failed"))
        batch.add("totals", new, TOTALS)

    run_folds(rows, location, checkpoint, fold, watermark)
    totals = Versions(attempts.sparkSession, location).rows("totals", TOTALS).drop("_seq").withColumn("late", F.lit(0))
    late = late_rows(rows, location).select(F.window("ts", window)["start"].alias("window_start"), "lane")
    none = [F.lit(0).alias(c) for c in ("started", "done", "failed")]
    both = totals.unionByName(late.select("window_start", "lane", *none, F.lit(1).alias("late")))
    return both.groupBy("window_start", "lane").agg(*[F.sum(c).alias(c) for c in ("started", "done", "failed", "late")])
