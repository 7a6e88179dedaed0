import hashlib
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from crawlspark.functions import urls as U
from crawlspark.rules import DEFAULT_RULES


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "url string").select(fn("url").alias("r")).first()["r"]


URLS = ["http://a.b.c/x/y;p=1?q=1#f", "HTTPS://WWW.Site.ORG:8443", "//cdn.x/lib.js", "mailto:a@b.c", "no-scheme/path", "",
        "http://h/p;a/b;c?d;e", "http://h?x=/a//b", "ftp://u:p@h:21/f#a?b", "  http://lead.ing/x", "http://h/a\tb"]


@pytest.mark.parametrize("url", URLS)
def test_url_parts_agree_with_urlparse(spark, url):
    got, want = one(spark, url, U.url_parts), urlparse(url)
    assert (got.scheme, got.authority, got.path, got.query, got.fragment) == (
        want.scheme, want.netloc, want.path, want.query, want.fragment)


@pytest.mark.parametrize("host,variants", [
    ("a.b.c", ["a.b.c", "b.c"]), ("foo.bar.example.com", ["foo.bar.example.com", "bar.example.com", "example.com"]),
    ("localhost", []), ("", []), ("x.y:8080", ["x.y:8080"])])
def test_host_variants(spark, host, variants):
    assert one(spark, host, U.host_variants) == variants


@pytest.mark.parametrize("url,host", [("http://www.wikipedia.org/", "wikipedia.org"), ("http://WWW.w.org:80/x", "w.org:80"),
                                      ("http://wwwx.org", "wwwx.org"), ("nothing", "")])
def test_norm_host_strips_a_prefix_not_characters(spark, url, host):
    assert one(spark, url, U.norm_host) == host


@pytest.mark.parametrize("url,pdf", [
    ("https://a.b/c/Paper.PDF", True), ("https://arxiv.org/pdf/1234", True), ("https://www.arxiv.org/abs/1234", False),
    ("https://export.arxiv.org/abs/1", False), ("https://x.openreview.net/f", True), ("https://notopenreview.net/f", False),
    ("https://www.nature.com/a", True), ("https://y.org/viewPDF/7", True), ("https://y.org/x?download=1", False),
    ("https://y.org/x?download=1&as=pdf", True), ("https://y.org/x.pdf;v=2", True), ("https://y.org/a", False)])
def test_is_pdf_url(spark, url, pdf):
    assert one(spark, url, U.is_pdf_url) is pdf


@pytest.mark.parametrize("url,spa", [("http://gist.github.com/x", True), ("http://github.com", True), ("http://mygithub.com", False),
                                     ("http://max.com", False), ("http://x.com/a", True), ("http://localhost", False)])
def test_is_spa_host(spark, url, spa):
    assert one(spark, url, U.is_spa_host) is spa


def test_host_in_equals_the_scan_of_all_rules(spark):
    hosts = [p + h for h in DEFAULT_RULES.spa_hosts + DEFAULT_RULES.pdf_hosts for p in ("", "a.", "x", "a.b.")] + ["", "com", "org"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", U.host_in("h", DEFAULT_RULES.pdf_hosts).alias("r"))
    for h, r in df.collect():
        assert r == any(h == t or h.endswith("." + t) for t in DEFAULT_RULES.pdf_hosts), h


@pytest.mark.parametrize("url,out", [
    ("http://zhihu.com/q/1?a=b", "https://www.zhihu.com/q/1?a=b"), ("http://www.zhihu.com/q", "https://www.zhihu.com/q"),
    ("https://zhuanlan.zhihu.com/p", "https://zhuanlan.zhihu.com/p"), ("http://other.com/x", "http://other.com/x"),
    ("//h.org/x", "http://h.org/x"), ("", "")])
def test_normalize_entry_url(spark, url, out):
    assert one(spark, url, U.normalize_entry_url) == out


@pytest.mark.parametrize("url,out", [("http://h/a/b/c.pdf?x", "/a/b/"), ("http://h/c.PDF", "/"), ("http://h/a/pdf", "/a/pdf"), ("http://h", "")])
def test_url_template(spark, url, out):
    assert one(spark, url, U.url_template) == out


@pytest.mark.parametrize("url,plain,site", [
    ("https://arxiv.org/pdf/2301.00001v2", "2301.00001v2.pdf", "arxiv_2301"), ("https://arxiv.org/abs/ab", "ab.pdf", "arxiv_paper"),
    ("https://www.biorxiv.org/content/10.1101/x.full.pdf", "x.full.pdf", "biorxiv_101101"),
    ("https://proceedings.mlr.press/v139/dong21a/dong21a.pdf", "dong21a.pdf", "pmlr_v139_dong21a"),
    ("https://h.org/a%20b+c.pdf", "a b+c.pdf", "a20bc"), ("https://h.org:80/", "h.org_80.pdf", "h_org80")])
def test_pdf_filename(spark, url, plain, site):
    assert one(spark, url, U.pdf_filename) == plain
    tag = hashlib.sha256(url.encode()).hexdigest()[:16]
    assert one(spark, url, lambda u: U.pdf_filename(u, style="site")) == f"{site}_{tag}.pdf"


LINKS = ["/a/b.png", "//c.d/e", "https://x/y", "r/s.png?q", "../up.png", "./here", "../../../top", "a/../b", "?p=1", "#f", "", "."]


@pytest.mark.parametrize("base", ["http://h.org/x/y/z.html?k=v", "https://h.org", "http://h.org/d/"])
@pytest.mark.parametrize("href", LINKS)
def test_absolute_link_agrees_with_urljoin(spark, base, href):
    got = spark.createDataFrame([(base, href)], "b string, h string").select(U.absolute_link("b", "h")).first()[0]
    want = urljoin(base, href)
    # The root path of a bare authority may or may not be written.
    assert got.replace("h.org/?", "h.org?").rstrip("/") == want.replace("h.org/?", "h.org?").rstrip("/")


def test_disposition_and_headers(spark):
    df = spark.createDataFrame([('attachment; filename="r.pdf"',), ("inline",), (None,), ("a; filename=x.bin; b=1",)], "h string")
    assert [r[0] for r in df.select(U.disposition_filename("h")).collect()] == ["r.pdf", None, None, "x.bin"]
    df = spark.createDataFrame([("http://a/b", {"content-type": "Application/PDF"}), ("http://a/b", {}), ("http://a/b.pdf?x", None)],
                               "u string, m map<string,string>")
    assert [r[0] for r in df.select(U.is_pdf_by_headers("u", "m")).collect()] == [True, False, True]


def test_cache_key(spark):
    df = spark.createDataFrame([("http://www.h.org/a/b.pdf",), ("http://www.h.org/a/b",), ("https://arxiv.org/pdf/1",)], "u string")
    assert [tuple(r[0]) for r in df.select(U.cache_key("u")).collect()] == [("h.org:/a/", "pdf"), ("h.org", None), ("arxiv.org", "pdf")]


def test_null_url(spark):
    row = spark.sql("SELECT CAST(NULL AS STRING) AS url").select(
        U.norm_host("url"), U.is_pdf_url("url"), U.is_spa_host("url"), F.size(F.coalesce(U.host_variants("url"), F.array()))).first()
    assert row[0] is None and row[1] is False and row[2] in (None, False)
