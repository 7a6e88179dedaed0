"""Plan shape: what must not happen at scale."""

import re

import pytest

from crawlspark.plans.queries import QUERIES
from crawlspark.rules import rule_tables

STREAMS_AND_SINKS = {"attempt_stream", "write_results", "save_load_state", "learn_scores_stream", "text_stability_stream", "stream_progress", "running_totals"}
PYTHON = {"decode_bodies"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS_AND_SINKS))
def test_no_cartesian_product_and_no_stray_python(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON:
        assert "Python" not in text and "MapInPandas" not in text and "ArrowEval" not in text


@pytest.mark.parametrize("name", ["is_pdf_url", "url_parts", "cached_route", "route_accuracy", "race_winner", "lane_plan", "learn_scores"])
def test_url_work_reads_no_page_body(spark, sf_dir, name):
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES[name](spark, sf_dir))):
        assert "html" not in schema


@pytest.mark.parametrize("name", ["learn_pdf_paths", "visit_curve"])
def test_ranked_limits_are_applied_before_the_shuffle(spark, sf_dir, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, sf_dir))


def test_rule_tables_have_a_known_small_size(spark):
    for name, df in rule_tables(spark).items():
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        assert size < 1 << 20, (name, size)


def test_page_work_is_map_only(spark, tmp_path):
    """Cleaning shuffles nothing, however few files there are."""
    from crawlspark.operators import cleaning
    from crawlspark.sources.readers import read_pages

    place = str(tmp_path / "pages")
    spark.range(64).selectExpr("id AS page_id", "'http://a.b/c' AS url", "concat('<p>', repeat('word ', 50), id) AS html").coalesce(1).write.parquet(place)
    pages = read_pages(spark, place)
    for df in (cleaning.clean_pages(pages), cleaning.main_blocks(pages), cleaning.prune_blocks(pages), cleaning.bm25_blocks(pages, "word"),
               cleaning.mapreduce_clean(pages)):
        assert "Exchange" not in plan(df)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS_AND_SINKS))
def test_no_round_robin_shuffle(spark, sf_dir, name):
    assert "RoundRobin" not in plan(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["batch_summary", "batch_code", "split_outcomes", "race_failures"])
def test_outcomes_come_from_one_aggregate(spark, sf_dir, name):
    # One scan of the events, apart from what lists the requests of a batch.
    assert plan(QUERIES[name](spark, sf_dir)).count("events.parquet") <= (6 if name == "batch_summary" else 2)
