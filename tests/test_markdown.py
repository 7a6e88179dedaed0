"""Nested lists and tables in Markdown, against expected text; the fold's work grows with the page."""

import time

import pytest
from pyspark.sql import functions as F

from crawlspark.functions.common import scan
from crawlspark.operators import cleaning

CASES = [
    ("<p>Intro</p><ul><li>one<ul><li>two</li><li>three<ol><li>x</li><li>y</li></ol></li></ul></li><li>four</li></ul><p>End</p>",
     "Intro\n\n- one\n  - two\n  - three\n    1. x\n    2. y\n- four\n\nEnd"),
    ("<ol><li><p>first</p><p>more</p></li>" + "<li>n</li>" * 8 + "<li>wide<ul><li>deep</li></ul></li></ol>tail",
     "1. first\n\n   more\n" + "".join(f"{k}. n\n" for k in range(2, 10)) + "10. wide\n    - deep\n\ntail"),
    ("<table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td><td></td></tr><tr><td><ul><li>x</li><li>y</li></ul><td>z</table><p>after</p>",
     "| a | b\\|c |\n| --- | --- |\n| 1 |  |\n| x y | z |\n\nafter"),
    ("<table><tr><td>open", "| open |\n| --- |"),
    ("<li>lone</li>plain", "- lone\n\nplain"),
    ("<table><caption>Cap</caption><tr><td>1<table><tr><td>in</td></tr></table></td><td>2</td></tr></table>",
     "Cap\n\n| 1 in | 2 |\n| --- | --- |"),
    ("<ul><li>a</li></ul><ul><li>b</li></ul><h2>T</h2>", "- a\n\n- b\n\n## T"),
    ("<ul><li><a href='/x'>link</a> and <b>bold</b></li></ul>", "- [link](/x) and **bold**"),
    ("</ul></ol></table></td><p>closed too often</p>", "closed too often"),
    ("<ul>text before<li>item</ul>", "text before\n\n- item"),
    ("<OL><LI>UP<LI>CASE</OL>", "1. UP\n2. CASE"),
    ("", ""), (None, ""),
]


def test_expected_markdown(spark):
    pages = spark.createDataFrame([(k, h) for k, (h, _) in enumerate(CASES)], "page_id long, html string")
    got = {r.page_id: r.markdown for r in cleaning.nested_markdown(pages, best=False).collect()}
    assert [got[k] for k in range(len(CASES))] == [want for _, want in CASES]


def test_best_part_drops_what_stands_around_it(spark):
    body = "<p>" + "content words " * 30 + "</p><ul><li>" + "more content " * 9 + "<ol><li>" + "inner text of it " * 5 + "</ol></ul>"
    html = "<ul><li><a href='/a'>menu</a></li></ul>" + body + "<table><tr><td><a href='/b'>foot</a></td></tr></table>"
    md = cleaning.nested_markdown(spark.createDataFrame([(1, html)], "page_id long, html string")).first().markdown
    assert md.startswith("content words") and "\n  1. inner text" in md and "menu" not in md and "foot" not in md and "|" not in md


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_scan_equals_running_sums(spark, n):
    items = F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")
    sums = scan(items, F.lit(0), "int", lambda s, x: F.struct((s + x).cast("int").alias("state"), (s + x).cast("int").alias("out")))
    assert spark.range(1).select(sums.alias("s")).first().s == [k * (k + 1) // 2 for k in range(1, n + 1)]


def test_work_grows_with_the_page(spark):
    def seconds(n):
        html = "<ul>" + "<li>item" * n + "</ul><table>" + "<tr><td>a<td>b" * n
        df = cleaning.nested_markdown(spark.createDataFrame([(1, html)], "page_id long, html string")).persist()
        start = time.perf_counter()
        size = len(df.first().markdown)
        df.unpersist()
        assert size > 10 * n
        return time.perf_counter() - start

    seconds(100)
    small, large = seconds(8_000), seconds(32_000)
    assert large < 10 * small  # four times the page
