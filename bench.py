"""Headline queries, timed; prints one JSON line.

The given tables are single files with one row group, which one task must read. Before the timing they are laid out in
as many files as there are cores, as a table of any size would be. BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all) choose data and cores. Every query runs
to a sink that takes all rows and columns, so nothing is pruned away from the timing.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from crawlspark.plans.fixtures import BASE  # noqa: E402
from crawlspark.plans.queries import QUERIES  # noqa: E402
from crawlspark.session import get_session  # noqa: E402

HEADLINE = (
    "host_report", "visible_text", "main_blocks", "blocks_markdown", "clean_pages", "mapreduce_clean", "spa_fingerprint",
    "block_indicator_tags", "is_pdf_url", "cached_route", "route", "race_winner", "race_failures", "apply_health",
    "content_health", "batch_summary", "learn_scores", "learn_pdf_paths", "text_stability", "visit_curve", "latency_table",
    "candidate_scores", "retention_summary", "decode_bodies", "stream_progress",
)


def laid_out(spark, sf_dir: str, files: int) -> str:
    place = tempfile.mkdtemp(prefix="bench-")
    for table in BASE:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(files).write.parquet(f"{place}/{table}.parquet")
    return place


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    name, sf_dir = sf_dir, laid_out(spark, sf_dir, int(cpus))
    QUERIES["host_report"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times: dict[str, float] = {}
    for query in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[query](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[query] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(name.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
