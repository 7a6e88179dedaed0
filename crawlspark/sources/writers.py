"""Sinks (SNK1, SNK2) and raw bodies for SRC4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(df: DataFrame, location: str, order: str = "pos", lane: str = "lane", mode: str = "errorifexists") -> None:
    """SNK1: results in input order, one file set per lane.

    Rows are range-partitioned by (lane, order), so a lane with most of the rows is cut into several ordered
    files instead of landing in one task.
    """
    (df.repartitionByRange(F.col(lane), F.col(order)).sortWithinPartitions(lane, order)
     .write.mode(mode).partitionBy(lane).parquet(location))


PACK_BELOW, PACK_RECORDS = 32 * 1024, 512


def write_bodies(df: DataFrame, location: str, text: str, below: int = PACK_BELOW, records: int = PACK_RECORDS) -> tuple[str, str]:
    """Each text and a line end as a raw body; returns the folder of single files and that of packed ones.

    Texts of ``below`` bytes and more get a file each. Smaller ones are packed, ``records`` to a file, which so holds less
    than 22 MB: the number of files grows with the bytes, not with the bodies. NULL is no body.
    """
    single, packed = f"{location.rstrip('/')}/single", f"{location.rstrip('/')}/packed"
    size, body = F.octet_length(text), F.concat(F.col(text), F.lit("\n")).cast("binary")
    df.filter(size >= below).select(text).write.option("maxRecordsPerFile", 1).text(single)
    line = F.replace(F.base64(body), F.lit("\r\n"), F.lit(""))  # Spark may part base64 into lines of 76
    df.filter(size < below).select(line.alias("line")).write.option("maxRecordsPerFile", records).text(packed)
    return single, packed


def _folder(spark: SparkSession, location: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(location)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target, jvm.org.apache.hadoop.fs.Path


def state_versions(spark: SparkSession, location: str, complete: bool = True) -> list[int]:
    """Complete versions only, if asked for: a write that was cut short has no success mark."""
    fs, root, make = _folder(spark, location)
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("version=") and (not complete or fs.exists(make(status.getPath(), "_SUCCESS"))):
            found.append(int(name.split("=", 1)[1]))
    return sorted(found)


def save_state(df: DataFrame, location: str, version: int | None = None) -> int:
    """SNK2: write a new version of the learned state; the version being read is never touched.

    A given ``version`` makes a repeated write of the same batch idempotent. An automatic one never replaces a folder:
    of two writers that take the same number the later fails, and a number after a cut-off write is skipped.
    """
    mode = "overwrite"
    if version is None:
        taken = state_versions(df.sparkSession, location, complete=False)
        version, mode = (taken[-1] + 1 if taken else 0), "errorifexists"
    df.write.mode(mode).parquet(f"{location.rstrip('/')}/version={version}")
    return version


def load_state(spark: SparkSession, location: str, version: int | None = None) -> DataFrame | None:
    """SNK2: the latest complete version (or the one named); None when there is none."""
    done = state_versions(spark, location)
    if version is None:
        if not done:
            return None
        version = done[-1]
    return spark.read.parquet(f"{location.rstrip('/')}/version={version}")
