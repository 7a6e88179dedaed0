"""Pages with cut and unclosed character references: queries equal their SQL twins, which read closed ones only."""

import duckdb
import pytest
from compare import differences
from pyspark.sql import functions as F

from crawlspark.functions import text as X
from crawlspark.plans.oracles import ORACLES
from crawlspark.plans.queries import QUERIES

NAMES = ["html_title", "main_blocks", "blocks_markdown", "nested_markdown", "prune_blocks", "bm25_blocks", "bm25_corpus", "mapreduce_clean",
         "clean_pages", "clean_pages_prune", "clean_pages_bm25", "block_indicator_tags"]


@pytest.fixture(scope="module")
def cut_dir(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("cut"))
    text = F.concat(F.lit("the la&amp;amp; der &lt;b&gt; &#39;q&apos;&nbsp;x &copy; &#8211; R&amp D&ampD &quot a&amp&amp; w"), F.col("id"))
    pages = spark.range(24).select(
        F.col("id").alias("page_id"), F.concat(F.lit("https://h"), F.col("id") % 5, F.lit(".example/p")).alias("url"),
        F.concat(F.lit("<html><head><title>Re&&&amp; the end&amp</title></head><body><h1>Re&&&amp; the end&amp"), F.lit("</h1><p>"), text,
                 F.lit("</p><pre> a&nbsp;b&lt</pre><p><a href='/x'>la&amp</a> the &am</p><p>"), F.repeat(text, F.col("id").cast("int") % 4),
                 F.lit("</p></body></html>")).alias("html"))
    pages.coalesce(1).write.parquet(f"{place}/pages.parquet")
    return place


@pytest.mark.parametrize("name", NAMES)
def test_cut_references_are_read_as_the_sql_reads_them(spark, cut_dir, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{cut_dir}/pages.parquet/*.parquet'")
    assert differences(QUERIES[name](spark, cut_dir), con.sql(ORACLES[name])) is None


def test_readings_of_references(spark):
    df = spark.createDataFrame([("a&amp;lt; &amp &copy; &lt;&nbsp;&#39;",)], "t string")
    got = df.select(X.unescape("t", "basic"), X.unescape("t"), X.html_title(F.concat(F.lit("<title>"), "t", F.lit("</title>")), None, "basic")).first()
    assert tuple(got) == ("a&lt; &amp &copy; < '", "a&lt; & © <\xa0'", "a&lt; &amp &copy; < '")
    with pytest.raises(ValueError):
        X.unescape("t", "none")
