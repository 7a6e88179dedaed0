"""Page cleaning jobs (TXT11-TXT13, TXT16, TXT18) and page-level checks (Q12)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import quality as Q
from ..functions import text as X
from ..functions.common import collapse_ws, exploded, let
from ..rules import DEFAULT_RULES, LOW_CONTENT_CHARS, SUSPICIOUS_STATUS, Rules
from ..session import shared_dir

EMPTY_BODY = "# 内容为空\n\n未获取到有效的HTML内容"  # fixed value
EMPTY_RESULT = "# 页面内容\n\n清理服务返回空内容，原始HTML长度: "  # fixed value, followed by the length


def with_blocks(pages: DataFrame, html: str = "html", references: str = "html5") -> DataFrame:
    """Adds ``blocks`` and ``bounds`` (the best contiguous range). A map-only step."""
    return (pages.withColumn("blocks", B.page_blocks(html, references))
            .withColumn("bounds", B.best_range("blocks")))


def main_blocks(pages: DataFrame, key: str = "page_id", references: str = "html5") -> DataFrame:
    """TXT11: one row per text block with its statistics and whether the best range holds it."""
    rows = exploded(with_blocks(pages.select(key, "html"), references=references), F.col("blocks"), "pos", "b", key, "bounds")
    at = F.col("pos") + 1
    return rows.select(
        key, F.col("b.idx").alias("idx"), F.col("b.tag").alias("tag"), F.col("b.text").alias("text"),
        F.col("b.chars").alias("chars"), F.col("b.link_chars").alias("link_chars"),
        F.round(B.link_density(F.col("b")), 6).alias("link_density"), F.col("b.md").alias("md"),
        ((at >= F.col("bounds.first")) & (at <= F.col("bounds.last"))).alias("kept"))


def nested_markdown(pages: DataFrame, key: str = "page_id", html: str = "html", best: bool = True,
                    references: str = "html5") -> DataFrame:
    """TXT11: Markdown with nested and numbered lists and tables; a map-only step, linear in the page."""
    return pages.select(key, F.coalesce(B.nested_markdown(html, best, references), F.lit("")).alias("markdown"))


def blocks_markdown(pages: DataFrame, key: str = "page_id", html: str = "html", references: str = "html5") -> DataFrame:
    """TXT11: Markdown of each page's best contiguous blocks, in order."""
    return with_blocks(pages.select(key, F.col(html).alias("html")), references=references).select(
        key, F.coalesce(B.join_markdown(B.kept_blocks("blocks", "bounds")), F.lit("")).alias("markdown"))


def prune_blocks(pages: DataFrame, threshold: float = 0.5, threshold_type: str = "fixed",
                 key: str = "page_id", references: str = "html5") -> DataFrame:
    """TXT12: blocks whose score reaches the threshold, with the page's Markdown made of them."""
    kept = pages.select(key, B.page_blocks("html", references).alias("blocks")).select(
        key, B.pruned("blocks", threshold, threshold_type).alias("blocks"))
    return kept.select(key, F.transform("blocks", lambda b: b["idx"]).alias("kept"),
                       B.join_markdown("blocks").alias("markdown"))


def bm25_blocks(pages: DataFrame, query: str = "main content", threshold: float = 1.2,
                key: str = "page_id", references: str = "html5") -> DataFrame:
    """TXT13: blocks whose BM25 score against the query reaches the threshold."""
    scored = exploded(pages.select(key, B.page_blocks("html", references).alias("blocks")), B.bm25_scores("blocks", query), "pos", "s", key)
    return scored.select(key, F.col("s.idx").alias("idx"), F.col("s.score").alias("score")).filter(
        F.col("score") >= threshold)


def bm25_corpus(pages: DataFrame, query: str, threshold: float = 1.2, key: str = "page_id", k1: float = 1.2, b: float = 0.75,
                references: str = "html5") -> DataFrame:
    """TXT13 over the corpus: BM25 of every block with the frequencies of all blocks of all pages.

    Pages are parsed once, into counts of the query's words, which are written; one sum over them gives the number of
    blocks, their mean length and each word's document frequency, and a map scores. No page text is shuffled.
    """
    spark = pages.sparkSession
    words = list(dict.fromkeys(B._query_words(query)))
    place = shared_dir(spark, "bm25")
    pages.select(key, B.query_counts(B.page_blocks("html", references), words).alias("blocks")).write.parquet(place)
    counts = spark.read.parquet(place)

    def held(i: int):
        return F.size(F.filter("blocks", lambda x: x["tf"][i] > 0))

    figures = counts.agg(F.sum(F.size("blocks")).alias("n"), F.sum(F.aggregate("blocks", F.lit(0).cast("long"), lambda a, x: a + x["length"])).alias("total"),
                         F.array(*[F.sum(held(i)) for i in range(len(words))]).cast("array<bigint>").alias("df"))
    # One row, whose size is that of the query.
    f = figures.first()
    mean = (f.total or 0) / max(f.n or 0, 1)
    idf = [math.log(1 + (f.n - d + 0.5) / (d + 0.5)) for d in f.df] if f.n else []

    def score(x):
        total = F.lit(0.0)
        for i, weight in enumerate(idf):
            norm = k1 * (1 - b + b * x["length"] / F.lit(mean or 1.0))
            total = total + F.lit(weight) * x["tf"][i] * (k1 + 1) / (x["tf"][i] + norm)
        return F.round(total, 6)

    scored = F.transform("blocks", lambda x: F.struct(x["idx"].alias("idx"), score(x).alias("score")))
    rows = exploded(counts, F.filter(scored, lambda x: x["score"] >= threshold), "pos", "s", key)
    return rows.select(key, F.col("s.idx").alias("idx"), F.col("s.score").alias("score"))


def split_pages(pages: DataFrame, target_kb: int = 512, overlap: int = 1024, key: str = "page_id") -> DataFrame:
    """TXT15: one row per chunk of a pre-cleaned page."""
    ready = pages.select(key, X.strip_script_style(X.strip_base64_images("html")).alias("html"))
    spans = exploded(ready, X.split_spans("html", target_kb, overlap), "pos", "s", key, "html")
    return spans.select(key, F.col("s.idx").alias("idx"), F.col("s.start").alias("start"), F.col("s.end").alias("end"),
                        F.substring("html", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("chunk"))


def mapreduce_clean(pages: DataFrame, target_kb: int = 512, key: str = "page_id", references: str = "html5") -> DataFrame:
    """TXT16: Markdown of pages cleaned chunk by chunk and put together in order, inside the row of each page.

    Chunks do not overlap, so no text is written twice. A page without content has no slice and empty Markdown.
    """
    def chunk_md(h, s):
        bl = B.page_blocks(F.substring(h, s["start"] + 1, s["end"] - s["start"]), references)
        return let(bl, lambda bs: B.join_markdown(B.kept_blocks(bs, B.best_range(bs))))

    ready = pages.select(key, F.coalesce(X.strip_script_style(X.strip_base64_images("html")), F.lit("")).alias("html"))
    parts = ready.select(key, let(F.col("html"), lambda h: F.transform(
        X.split_spans(h, target_kb, 0), lambda s: chunk_md(h, s))).alias("parts"))
    return parts.select(key, F.array_join(F.filter("parts", lambda m: collapse_ws(m) != ""), "\n\n").alias("markdown"),
                        F.size("parts").cast("long").alias("slices"))


def clean_pages(pages: DataFrame, approach: str = "range", ignore_links: bool = False, ignore_images: bool = False,
                query: str = "main content", threshold: float | None = None, key: str = "page_id",
                references: str = "html5", blank: str | None = EMPTY_BODY) -> DataFrame:
    """TXT18: Markdown of each page with statistics; one pass over the input, the same for every size.

    ``approach`` chooses the blocks: the best contiguous ``range``, ``prune`` by score or ``bm25`` against a query.
    A page without HTML gets the placeholder ``blank`` and no success; one whose blocks hold nothing a placeholder that
    says so, with the length of its HTML. ``blank=None``: both get the latter.
    """
    size = F.coalesce(F.length("html").cast("string"), F.lit(""))
    base = pages.select(key, F.coalesce(F.col("html"), F.lit("")).alias("html"), size.alias("size"))
    if approach == "range":
        chosen = let(B.page_blocks("html", references), lambda bs: B.kept_blocks(bs, B.best_range(bs)))
    elif approach == "prune":
        chosen = B.pruned(B.page_blocks("html", references), 0.5 if threshold is None else threshold)
    elif approach == "bm25":
        limit = 1.2 if threshold is None else threshold
        chosen = let(B.page_blocks("html", references), lambda bs: let(B.bm25_scores(bs, query), lambda ss: F.filter(
            bs, lambda b, i: F.get(ss, i)["score"] >= limit)))
    else:
        raise ValueError(f"unknown approach: {approach}")
    markdown = B.join_markdown(chosen)
    if ignore_links or ignore_images:
        markdown = X.strip_md_links(markdown, images=ignore_images, links=ignore_links)
    none = collapse_ws("html") == ""
    staged = base.withColumn("markdown", F.when(~none, markdown)).withColumn(
        "is_empty", none | (collapse_ws(F.coalesce("markdown", F.lit(""))) == ""))
    body = F.when(F.col("is_empty"), F.concat(F.lit(EMPTY_RESULT), "size", F.lit(" 字符"))).otherwise(F.col("markdown"))
    if blank is not None:
        body = F.when(none, blank).otherwise(body)
    label = F.when(none, "placeholder").otherwise("readability-single")
    out = staged.select(key, "html", body.alias("markdown"), label.alias("cleaner"), "is_empty", (~none).alias("success"))
    return out.select(key, "markdown", "cleaner", "is_empty", "success",
                      X.cleaning_stats("html", "markdown").alias("stats"))


def fast_lane_gate(pages: DataFrame, text_limit: int = 150, clean: bool = True, mode: str = "unicode") -> DataFrame:
    """Q3: gate error per fetched body (``html``, ``body`` and, when cleaning, ``markdown``)."""
    plain = X.probe_text("html")
    n = F.length(X.probe_text("markdown")) if clean else None
    return (pages.withColumn("plain_text", plain)
            .withColumn("gate_error", Q.lane_gate("plain_text", "body", n, text_limit, mode))
            .withColumn("passed", F.col("gate_error").isNull()))


def block_indicator_tags(pages: DataFrame, rules: Rules = DEFAULT_RULES, key: str = "page_id", references: str = "html5") -> DataFrame:
    """Q12: per page, section and language the number of listed terms present, with status and length flags."""
    staged = pages.select(key, "url", "status_code", "html", X.visible_text("html").alias("_text"),
                          X.html_title("html", None, references).alias("_title"))
    rows = exploded(
        staged, Q.block_term_hits("_text", "_title", "url", "html", rules), "pos", "h", key,
        F.coalesce(F.col("status_code").isin(*SUSPICIOUS_STATUS), F.lit(False)).alias("suspicious_status"),
        (F.length("_text") < LOW_CONTENT_CHARS).alias("low_content"))
    return rows.select(key, "h.section", "h.language", "h.hits", "suspicious_status", "low_content")
