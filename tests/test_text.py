import html
import random
import re
import time
from html.entities import html5

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlspark.functions import blocks as B
from crawlspark.functions import quality as Q
from crawlspark.functions import text as X
from crawlspark.functions.common import collapse_ws, strip_ws
from crawlspark.operators import cleaning


def col1(spark, values, fn, schema="html string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r[1] for r in sorted(df.select("i", fn("html")).collect())]


ODD = ["", " ", "\n a\x1c b　", "<a", "a<b<c", "<>x<y>z", "<script>a</script", "<SCRIPT x>var a='</p>'</script>t<style>q</STYLE>",
       "<p>a &amp;lt; b&nbsp;</p>", "é你😀 <b>x</b>", "a b\u0085c"]


VISIBLE = ["", "", "a\x1c b", "<a", "a", "y", "a</script", "t", "a &amp;lt; b&nbsp;", "é你😀 x", "a b\u0085c"]


def test_visible_text_and_whitespace(spark):
    visible = col1(spark, ODD, X.visible_text)
    assert [v for k, v in enumerate(visible) if k not in (2, 4, 5, 10)] == [v for k, v in enumerate(VISIBLE) if k not in (2, 4, 5, 10)]
    assert (visible[2], visible[4], visible[5], visible[10]) == ("a b", "a<b<c", "<>xz", "a b c")
    assert col1(spark, ODD, strip_ws) == [h.strip() for h in ODD]
    assert col1(spark, ODD, collapse_ws) == [" ".join(h.split()) for h in ODD]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="<>ab /!\n ", max_size=40), min_size=1, max_size=30))
def test_strip_tags_is_the_plain_regex(spark, texts):
    assert col1(spark, texts, X.strip_tags) == [re.sub(r"<[^>]+>", "", t) for t in texts]
    assert col1(spark, texts, lambda c: X.strip_tags(c, " ")) == [re.sub(r"<[^>]+>", " ", t) for t in texts]


def test_long_inputs_neither_overflow_nor_stall(spark):
    texts = ["<script>" + "x<y" * 80_000 + "</script>ok", "a<b " * 200_000, "<p>" + "é < " * 100_000]
    assert [len(t) for t in col1(spark, texts, X.visible_text)] == [2, 799_999, 399_999]


@pytest.mark.parametrize("fn", [X.visible_text, X.strip_base64_images, X.strip_script_style])
def test_idempotent(spark, sf_dir, fn):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet").select(fn("html").alias("a"))
    assert df.filter(fn("a") != F.col("a")).count() == 0


def test_character_references(spark):
    cases = {"Caf&eacute; &#8211; it&#x27;s &copy;": "Café – it's ©", "&amp;lt; &amp;amp;": "&lt; &amp;", "a & b &nosuch; &;": "a & b &nosuch; &;",
             "&#0;&#xD800;&#1114112;": "\ufffd" * 3, "&#128512;&lt": "😀<", "&nbsp;&apos;&hearts;": "\xa0'♥", "": "", "&": "&", "&#x;&#;": "&#x;&#;",
             "&notit; &notin; &copyx &ampamp;": "¬it; ∉ ©x &amp;", "&#128;&#x9f;&#65x&#000000000065;&#1;|&#99999999999;": "€ŸAxA|\ufffd",
             "&NotEqualTilde;&CounterClockwiseContourIntegral;&semi;&equals;&bne;": "≂̸∳;==⃥"}
    assert col1(spark, list(cases), X.unescape) == list(cases.values()) == [html.unescape(t) for t in cases]
    every = ["x&" + name + "y" for name in html5] + [f"&#{n};&#x{n:X}z" for n in (*range(0x100), 0xFDD0, 0xFFFE, 0x1FFFF, 0x10FFFF)]
    assert col1(spark, every, X.unescape) == [html.unescape(t) for t in every]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="&#xX;19aAmplttgno ", max_size=30), min_size=1, max_size=30))
def test_character_references_are_those_of_html(spark, texts):
    assert col1(spark, texts, X.unescape) == [html.unescape(t) for t in texts]


def test_titles(spark):
    assert col1(spark, ["<title> A &amp;amp; B\n</TITLE>", "<title></title>", "none", None], X.html_title) == ["A &amp; B", "无标题", "无标题", "无标题"]
    docs = ["Title: T \nx", "\nHead\n\n===============\n# no", "intro\n## Two", "URL Source: u\nMarkdown Content:\n first", "", "===============\n# One", "#no\nx"]
    assert col1(spark, docs, X.markdown_title) == ["T", "Head", "Two", "first", "", "One", "#no"]


def test_base64_and_links(spark):
    assert col1(spark, ['<IMG a src="data:image/png;base64,QQ==" b>x url("data:image/gif;base64,AA") data:image/png;base64,Zm9v,'],
                X.strip_base64_images) == ["<!-- base64-img-removed -->x url(#base64-removed) #base64-removed,"]
    assert col1(spark, ["![a](data:image/png;base64,QQ==) [t](data:image/png;base64,QQ) data:image/png;base64,QQ=="],
                X.strip_base64_markdown) == ["![图片已移除] [base64-link-removed] #base64-removed"]
    assert col1(spark, ["![p](x)[a](b)[c](d) e"], X.strip_md_links) == [" e"]
    assert col1(spark, ["![p](x)[a](b)"], lambda c: X.strip_md_links(c, images=False)) == ["![p](x)"]


def test_icons(spark):
    page = ('<link rel="apple-touch-icon" href="t.png"><link href="/f.ico" rel="ICON"><link rel="shortcut icon" href="//c/s.ico">'
            '<link rel="icon" href="">')
    df = spark.createDataFrame([(page, "https://h.org/a/b"), ("x", "https://h.org/a/b")], "html string, url string")
    assert [r[0] for r in df.select(X.icon_links("html", "url")).collect()] == [
        ["https://h.org/f.ico", "https://c/s.ico", "https://h.org/t.png"], ["https://h.org/favicon.ico"]]


def test_failure_markdown(spark):
    row = spark.sql("SELECT 'http://u' AS u, 'e1' AS a, CAST(NULL AS STRING) AS b, 'e3' AS c").select(
        X.failure_markdown("u", "a", "b", "c"), X.failure_markdown("u", "b", "b", "b")).first()
    assert row[0] == "# 爬取失败\n\n**URL:** http://u\n\n**失败原因:** EasyGet: e1 | Jina: e3"
    assert row[1].endswith("**失败原因:** 未知错误")


def test_split_spans(spark):
    target, overlap, reach = 65536, 1024, 4096
    pages = ["", "x" * 10, ("y" * 997 + "</p>") * 300, "z" * 300_000, ("é" * 5000 + "\n\n") * 60, "q" * 65536, ("w" * 70000 + "</div>") * 4]
    for page, spans in zip(pages, col1(spark, pages, lambda c: X.split_spans(c, 64, overlap))):
        assert [s.idx for s in spans] == list(range(len(spans)))
        if not page:
            assert not spans
            continue
        # Without their overlap the spans are the page, cut into consecutive parts.
        cuts = [min(s.end, len(page)) - (overlap if s.end < len(page) or k < len(spans) - 1 else 0) for k, s in enumerate(spans)]
        assert spans[0].start == 0 and spans[-1].end == len(page)
        for k, s in enumerate(spans[1:], 1):
            assert s.start == max(0, cuts[k - 1] - overlap)
        for before, cut in zip([0, *cuts], cuts[:-1]):
            goal = before + target
            part = page[goal:goal + reach]
            marks = [part.find(m) + len(m) for m in ("</p>", "</div>", "\n\n") if m in part]
            assert cut == goal + min(marks, default=0)


def test_split_spans_refuses_small_chunks():
    for bad in ((63, 0), (64, -1)):
        with pytest.raises(ValueError):
            X.split_spans("html", *bad)


PAGE = ("<html><head><title>T</title></head><body><nav><ul><li><a href='/1'>menu</a></li></ul></nav><h1>Head &amp; more</h1>"
        "<p>First <b>bold</b> paragraph with a <a href='http://x/y'>link</a> in running text.<p>Second paragraph, unclosed, long enough."
        "<ul><li>item one is here</li><li>item two is here</li></ul><pre>\n  code  line\n    indented</pre><blockquote>quoted words here</blockquote>"
        "<img src='/i.png' alt='pic'><footer>foot</footer></body></html>")


def test_blocks_markdown(spark):
    df = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    md = cleaning.blocks_markdown(df).first()["markdown"]
    assert md == ("# Head & more\n\nFirst **bold** paragraph with a [link](http://x/y) in running text.\n\n"
                  "Second paragraph, unclosed, long enough.\n\n- item one is here\n\n- item two is here\n\n"
                  "```\n  code  line\n    indented\n```\n\n> quoted words here![pic](/i.png)")


def test_empty_and_plain_pages_keep_their_text(spark):
    df = spark.createDataFrame([(1, ""), (2, "just words"), (3, None), (4, "<p>hi</p>")], "page_id long, html string")
    got = {r.page_id: r.markdown for r in cleaning.blocks_markdown(df).collect()}
    assert got[2] == "just words" and got[4] == "hi" and not got[1]


def test_mapreduce_of_a_small_page_is_the_single_pass(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    single = cleaning.blocks_markdown(pages).withColumnRenamed("markdown", "one")
    both = single.join(cleaning.mapreduce_clean(pages), "page_id")
    assert both.count() == pages.count()
    assert both.filter((F.col("one") != F.col("markdown")) | (F.col("slices") != 1)).count() == 0


def test_clean_pages_treats_all_sizes_alike(spark):
    block = "<p>Paragraph number {} with enough words to be kept.</p>"
    page = "<body>" + "".join(block.format(i) for i in range(4000)) + "</body>"
    pages = [(1, page), (2, page * 30), (3, "<p>42</p>"), (4, "<div><p>Yes it</p></div>"), (5, ""), (6, None), (7, "<script>x</script>")]
    got = {r.page_id: r for r in cleaning.clean_pages(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    assert got[1].markdown.split("\n\n") == [f"Paragraph number {i} with enough words to be kept." for i in range(4000)]
    assert got[2].markdown == "\n\n".join([got[1].markdown] * 30)
    assert (got[3].markdown, got[4].markdown) == ("42", "Yes it")
    assert [got[k].is_empty for k in range(1, 8)] == [False] * 4 + [True] * 3
    assert [got[k].success for k in range(1, 8)] == [True] * 4 + [False, False, True]


def test_clean_pages_options(spark):
    df = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    bare = cleaning.clean_pages(df, ignore_links=True, ignore_images=True).first().markdown
    assert "](" not in bare and "First **bold** paragraph" in bare
    assert cleaning.clean_pages(df, "bm25", query="quoted", threshold=0.1).first().markdown.startswith("> quoted words")
    assert "item one" in cleaning.clean_pages(df, "prune", threshold=0.0).first().markdown
    with pytest.raises(ValueError):
        cleaning.clean_pages(df, "magic")


@pytest.mark.parametrize("tag", ["<script>", "<nav>", "<!--", "<style ", "<head>"])
def test_unclosed_tags_take_linear_time(spark, tag):
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, f"{tag} text " * (n // len(tag + " text ")))], "page_id long, html string")
        start = time.perf_counter()
        df.select(X.visible_text("html").alias("a"), F.size(B.page_blocks("html")).alias("b")).collect()
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(1_000_000) < 10


def test_best_range_is_the_best_of_all_ranges(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(B.page_blocks("html").alias("b")).select("b", B.best_range("b").alias("r"))
    for blocks, r in pages.collect():
        worth = [max(v, 1) if re.fullmatch("h[1-6]", x.tag) else v for x in blocks for v in [x.chars - 2 * x.link_chars - B.BLOCK_COST]]
        best = max(sum(worth[i:j]) for i in range(len(worth)) for j in range(i + 1, len(worth) + 1))
        if best > 0:
            assert sum(worth[r.first - 1:r.last]) == best


def test_health(spark):
    long = "word " * 200
    cases = [("", None, "PAGE_NOT_LOADED", "empty_text"), (None, 200, "PAGE_NOT_LOADED", "empty_text"), ("short", 200, "PAGE_PARTIAL_LOAD", "partial_text"),
             (long, 403, "BLOCKED_ACCESS_DENIED", "status_code"), (long, 429, "BLOCKED_VERIFICATION", "status_code"), (long, 500, None, None),
             ("Just a Moment...", 200, "BLOCKED_CLOUDFLARE", "blocked_keywords"), ("请完成验证码", 200, "BLOCKED_VERIFICATION", "blocked_keywords"),
             ("please enable javascript", 200, "REQUIRE_JAVASCRIPT", "blocked_keywords"), ("x timed out", 200, "TIMEOUT", "blocked_keywords"),
             ("x timed out " + "y " * 150, 200, None, None), (long + " captcha", 200, None, None),
             (long + " too short", 200, "PAGE_PARTIAL_LOAD", "blocked_keywords")]
    df = spark.createDataFrame([(i, t, s) for i, (t, s, _, _) in enumerate(cases)], "i int, t string, s int")
    got = [r.h for r in df.select("i", Q.content_health("t", "s").alias("h")).orderBy("i").collect()]
    assert [(g.reason, g.hit) for g in got] == [(r, h) for _, _, r, h in cases]
    assert [g.ok for g in got] == [r is None for _, _, r, _ in cases]


def test_reason_from_text_looks_at_markup_of_short_pages_only(spark):
    df = spark.createDataFrame([("ok words", "<div class='g-reCAPTCHA'>"), ("w " * 300, "captcha"), ("", "captcha"), ("ok", None)], "t string, h string")
    assert [r[0] for r in df.select(Q.reason_from_text("t", "h")).collect()] == ["BLOCKED_VERIFICATION", None, None, None]


def test_magic_and_ratio(spark):
    raw = [b"%PDF-1.4", b"\x89PNG\r\n", b"GIF89a..", b"\xff\xd8\xff\xe0", b"PK\x03\x04", b"\x1f\x8b\x08", b"BM..", b"\x00\x00\x01\x00", b"<html>", b""]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "i int, b binary")
    assert [r[1] for r in df.select("i", Q.magic_type("b")).orderBy("i").collect()] == ["PDF", "PNG", "GIF", "JPEG", "ZIP", "GZIP", "BMP", "ICO", "", ""]
    texts = ["你好" * 50, "\x00\x01" * 50, "", "plain"]
    assert col1(spark, texts, Q.is_probably_binary) == [False, True, False, False]
    assert col1(spark, texts, lambda c: Q.is_probably_binary(c, mode="ascii")) == [True, True, False, False]


def test_custom_framework_patterns_match(spark):
    from dataclasses import replace

    rules = replace(Q.DEFAULT_RULES, spa_patterns=("__NEXT_DATA__", r"main_[0-9a-f]+\.js"))
    pages = ['<script id="__NEXT_DATA__">', '<script src="/main_0a1f.js">', '<p>x</p>']
    assert col1(spark, pages, lambda c: Q.framework_scripts(c, rules)) == [True, True, False]


def test_framework_script_search_equals_the_full_alternation(spark):
    names = ["/react-dom.min.js", "vue.js", "x.js", "@angular/core", "tailwind.min.css", "app-2.min.js", "react.development.js", "A" * 200_000,
             "https://cdn/npm/next.js?v=1", "page.js", "es6.js", "jquery.js", "data/jQuery3.js bundle.js.map", "emotion.css"]
    full = "(?i)" + "|".join(Q.DEFAULT_RULES.spa_patterns)
    assert col1(spark, names, Q.framework_scripts) == col1(spark, names, lambda c: F.col(c).rlike(full))


@pytest.mark.parametrize("name, unit, make", [
    ("title", "<title>", X.html_title), ("title tag", "<title ", X.html_title), ("image", "![a", X.strip_base64_markdown),
    ("data", "![a](data:image/", X.strip_base64_markdown), ("data body", "![a](data:image/png;base64,QUJD", X.strip_base64_markdown),
    ("label", "[a", X.strip_md_links), ("link", "[a](", X.strip_md_links), ("closed", "[a)", X.strip_md_links), ("images", "[a ![", X.strip_md_links), ("embed", "<embed ", X.has_pdf_embed),
    ("frame", "<iframe src='", X.has_pdf_embed), ("anchor", "<a href='x'>t", B._inline_markdown), ("bold", "<b>t", B._inline_markdown),
    ("img", "<img ", B._inline_markdown), ("linked", "<a href='x'>t", B._linked)])
def test_a_megabyte_of_open_marks_takes_linear_time(spark, name, unit, make):
    def seconds(n, end):
        df = spark.createDataFrame([(unit * (n // len(unit)) + end,)], "t string").select(make(F.col("t")).alias("r"))
        start = time.perf_counter()
        df.collect()
        return time.perf_counter() - start

    seconds(1000, "")
    assert seconds(1_000_000, "") < 6 and seconds(1_000_000, " ](x) </title></a></b> >") < 6


def test_links_go_as_the_plain_patterns_say(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choices(["[", "]", "(", ")", "](", "!", "a", "\n", " "], k=rnd.randrange(30))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(X.strip_md_links("t").alias("x"), X.strip_md_links("t", links=False).alias("y"), X.strip_md_links("t", images=False).alias("z"), "t").collect()
    image, link = r"!\[[^\n]*?\]\([^\n]*?\)", r"(?<!!)\[[^\n]*?\]\([^\n]*?\)"
    for r in got:
        assert (r.x, r.y, r.z) == (re.sub(link, "", re.sub(image, "", r.t)), re.sub(image, "", r.t), re.sub(link, "", r.t))
