"""Page blocks and Markdown as in-row array expressions (TXT11-TXT13).

Everything about one page stays inside its row: no block is exploded and regrouped, so page text never
crosses a shuffle. The cut points tolerate unclosed tags: the page is split at block-opening tags.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import ascii_classes, col, collapse_ws, let, scan
from .text import drop_up_to, strip_base64_images, strip_script_style, strip_tags, unescape

MARK = "\x01"
BLOCK_TAGS = "p|h[1-6]|li|pre|td|th|blockquote|div|section|article|main|ul|ol|table|tr|body"
BLOCK_OPEN = rf"(?i)(<(?:{BLOCK_TAGS})\b)"
# What is no content, in the order of removal: pattern and how each match ends.
NOISE = ((r"(?is)<!--.*?-->", "-->"), (r"(?is)<head(?:\s[^>]*)?>.*?</head>", "</head>"),
         *((rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", f"</{tag}>") for tag in ("nav", "header", "footer", "aside")))
INLINE = r"(?i)<(?:a|img|b|strong|i|em|code)\b"
LINK = r"(?is)<a\b[^<>]*>(.*?)</a>"
BLOCK_COST = 10  # characters a block must bring to be worth keeping

TAG_WEIGHTS = {"p": 1.0, "pre": 1.0, "blockquote": 1.0, "article": 1.5, "section": 1.0, "main": 1.5,
               "h1": 1.2, "h2": 1.1, "h3": 1.0, "h4": 0.9, "h5": 0.8, "h6": 0.7,
               "li": 0.5, "td": 0.5, "th": 0.5, "div": 0.5}


def content_html(html) -> Column:
    """Page markup without inline images, scripts, styles, comments, head and navigation."""
    out = strip_script_style(strip_base64_images(html))
    for pattern, last in NOISE:
        out = drop_up_to(out, ascii_classes(pattern), last)
    return out


def _plain(c: Column, references: str) -> Column:
    return collapse_ws(unescape(strip_tags(F.regexp_replace(c, ascii_classes(r"(?i)<br\b[^>]*>"), " "), "", r"<[^>]*>"), references))


def _inline_markdown(c: Column) -> Column:
    """Links, images, emphasis and code become Markdown before the remaining tags go."""
    q = r"""["']([^"'<>]*)["']"""
    out = F.regexp_replace(c, ascii_classes(rf"(?is)<img\b(?=[^<>]*\ssrc\s*=\s*{q})(?=[^<>]*\salt\s*=\s*{q})[^<>]*>"), "![$2]($1)")
    out = F.regexp_replace(out, ascii_classes(rf"(?is)<img\b(?=[^<>]*\ssrc\s*=\s*{q})[^<>]*>"), "![]($1)")
    out = drop_up_to(out, ascii_classes(rf"(?is)<a\b[^<>]*\shref\s*=\s*{q}[^<>]*>(.*?)</a>"), "</a>", "[$2]($1)")
    out = drop_up_to(out, ascii_classes(r"(?is)<(?:b|strong)(?:\s[^<>]*)?>(.*?)</(?:b|strong)>"), "</(?:b|strong)>", "**$1**")
    out = drop_up_to(out, ascii_classes(r"(?is)<(?:i|em)(?:\s[^<>]*)?>(.*?)</(?:i|em)>"), "</(?:i|em)>", "_$1_")
    return drop_up_to(out, ascii_classes(r"(?is)<code(?:\s[^<>]*)?>(.*?)</code>"), "</code>", "`$1`")


def _linked(segment: Column) -> Column:
    """What stands inside the links; none ends beyond the last end of a link."""
    return F.array_join(F.regexp_extract_all(F.regexp_extract(segment, r"(?is)^(.*</a>)", 1), F.lit(ascii_classes(LINK)), F.lit(1)), " ")


def _line(segment: Column, tag: Column, text: Column, references: str) -> Column:
    flat = F.when(segment.rlike(ascii_classes(INLINE)), _plain(_inline_markdown(segment), references)).otherwise(text)
    raw = F.regexp_replace(F.rtrim(unescape(strip_tags(segment, "", r"<[^>]*>"), references)), ascii_classes(r"^\s*\n|\s+\z"), "")
    return (F.when(tag.rlike("^h[1-6]$"),
                   F.concat(F.repeat(F.lit("#"), F.substring(tag, 2, 1).try_cast("int")), F.lit(" "), flat))
            .when(tag == "li", F.concat(F.lit("- "), flat))
            .when(tag == "blockquote", F.concat(F.lit("> "), flat))
            .when(tag == "pre", F.concat(F.lit("```\n"), raw, F.lit("\n```")))
            .otherwise(flat))


def page_blocks(html, references: str = "html5") -> Column:
    """TXT11: array of (idx, tag, text, chars, link_chars, html_chars, md) for blocks that hold text.

    ``references``: which character references are read, as in :func:`unescape`; so in all that is made of blocks.
    """
    segments = F.split(F.regexp_replace(content_html(html), ascii_classes(BLOCK_OPEN), MARK + "$1"), MARK)

    def block(segment: Column, idx: Column) -> Column:
        tag = F.lower(F.regexp_extract(segment, r"^<([A-Za-z][A-Za-z0-9]*)", 1))
        tag = F.when(tag == "", "div").otherwise(tag)
        return F.struct(idx.alias("idx"), tag.alias("tag"), _plain(segment, references).alias("text"), segment.alias("segment"))

    def facts(b: Column) -> Column:
        links = F.when(b["segment"].rlike(ascii_classes(r"(?i)<a\b")), F.length(_plain(_linked(b["segment"]), references))).otherwise(0)
        return F.struct(
            b["idx"].alias("idx"), b["tag"].alias("tag"), b["text"].alias("text"), F.length(b["text"]).alias("chars"),
            links.alias("link_chars"), F.length(b["segment"]).alias("html_chars"),
            _line(b["segment"], b["tag"], b["text"], references).alias("md"))

    # Two steps, so that a segment without text costs no more than its first look.
    return F.transform(F.filter(F.transform(segments, block), lambda b: b["text"] != ""), facts)


def link_density(b: Column) -> Column:
    return F.when(b["chars"] > 0, b["link_chars"] / b["chars"]).otherwise(F.lit(0.0))


def _worth(b: Column) -> Column:
    value = b["chars"] - b["link_chars"] * 2 - BLOCK_COST
    return F.when(b["tag"].rlike("^h[1-6]$"), F.greatest(value, F.lit(1))).otherwise(value)


def best_range(blocks) -> Column:
    """Struct (first, last): 1-based positions of the contiguous blocks with the largest total worth."""
    blocks = col(blocks)

    def step(acc: Column, b: Column) -> Column:
        pos = acc["pos"] + 1
        fresh = acc["sum"] <= 0
        total = F.when(fresh, _worth(b)).otherwise(acc["sum"] + _worth(b))
        first = F.when(fresh, pos).otherwise(acc["first"])
        better = total > acc["best"]
        return F.struct(pos.alias("pos"), total.alias("sum"), first.alias("first"),
                        F.when(better, total).otherwise(acc["best"]).alias("best"),
                        F.when(better, first).otherwise(acc["best_first"]).alias("best_first"),
                        F.when(better, pos).otherwise(acc["best_last"]).alias("best_last"))

    zero = F.lit(0)
    start = F.struct(zero.alias("pos"), zero.alias("sum"), zero.alias("first"), zero.alias("best"),
                     zero.alias("best_first"), zero.alias("best_last"))
    # No block worth keeping: keep them all rather than lose the page.
    return let(F.aggregate(blocks, start, step), lambda got: F.struct(
        F.when(got["best"] > 0, got["best_first"]).otherwise(1).alias("first"),
        F.when(got["best"] > 0, got["best_last"]).otherwise(got["pos"]).alias("last")))


def kept_blocks(blocks, bounds) -> Column:
    blocks, bounds = col(blocks), col(bounds)
    return F.slice(blocks, bounds["first"], F.greatest(bounds["last"] - bounds["first"] + 1, F.lit(0)))


def join_markdown(blocks) -> Column:
    return F.array_join(F.transform(col(blocks), lambda b: b["md"]), "\n\n")


# Where lists and tables open, end and are divided, besides the blocks.
STRUCTURE = rf"(?i)(<(?:{BLOCK_TAGS})\b|</(?:ul|ol|li|table|tr|td|th)\b)"
_STACK = "array<struct<kind:string,n:int,pad:int,fresh:boolean>>"


def _structure(html, references: str) -> Column:
    """Every stretch between structural tags: idx, tag (``/`` before that of an end), text, and its parts for Markdown."""
    segments = F.split(F.regexp_replace(content_html(html), ascii_classes(STRUCTURE), MARK + "$1"), MARK)

    def look(segment: Column, idx: Column) -> Column:
        tag = F.lower(F.regexp_extract(segment, r"^<(/?[A-Za-z][A-Za-z0-9]*)", 1))
        return F.struct(idx.alias("idx"), F.when(tag == "", "div").otherwise(tag).alias("tag"), _plain(segment, references).alias("text"),
                        segment.alias("segment"))

    def facts(b: Column) -> Column:
        flat = F.when(b["segment"].rlike(ascii_classes(INLINE)), _plain(_inline_markdown(b["segment"]), references)).otherwise(b["text"])
        links = F.when(b["segment"].rlike(ascii_classes(r"(?i)<a\b")), F.length(_plain(_linked(b["segment"]), references))).otherwise(0)
        md = F.when(b["tag"] == "li", flat).otherwise(_line(b["segment"], b["tag"], b["text"], references))
        return F.struct(b["idx"].alias("idx"), b["tag"].alias("tag"), b["text"].alias("text"),
                        F.length(b["text"]).alias("chars"), links.alias("link_chars"),
                        F.when(b["text"] == "", "").otherwise(flat).alias("flat"), F.when(b["text"] == "", "").otherwise(md).alias("md"))

    return F.transform(F.transform(segments, look), facts)


def _lists(stack: Column, b: Column) -> Column:
    """The stack of open lists after the tag of a stretch; ``fresh``: the item has no text yet."""
    top, depth, tag = F.try_element_at(stack, F.lit(-1)), F.size(stack), b["tag"]

    def entry(kind, n, pad, fresh) -> Column:
        return F.array(F.struct(kind.alias("kind"), n.cast("int").alias("n"), pad.cast("int").alias("pad"), fresh.alias("fresh")))

    def below(n: int) -> Column:
        return F.slice(stack, F.lit(1), F.greatest(depth - n, F.lit(0)))

    opened = entry(tag, F.lit(0), F.when(depth > 0, top["pad"] + _marker_width(top)).otherwise(0), F.lit(False))
    item = entry(top["kind"], top["n"] + 1, top["pad"], F.lit(True))
    return (F.when(tag.isin("ul", "ol"), F.concat(stack, opened)).when(tag.isin("/ul", "/ol"), below(1))
            .when((tag == "li") & (depth > 0), F.concat(below(1), item)).otherwise(stack).cast(_STACK))


def _marker_width(top: Column) -> Column:
    return F.when(top["kind"] == "ol", F.length(top["n"].cast("string")) + 2).otherwise(2)


def _listed(s: Column, stack: Column, b: Column) -> Column:
    """A stretch outside tables: state and Markdown."""
    top, depth, has = F.try_element_at(stack, F.lit(-1)), F.size(stack), b["md"] != ""
    in_item = (depth > 0) & (top["n"] > 0)
    marker = F.when(top["kind"] == "ol", F.concat(top["n"].cast("string"), F.lit(". "))).otherwise("- ")
    item = F.concat(F.when((s["prev"] == "item") & top["fresh"], "\n").otherwise("\n\n"), F.repeat(F.lit(" "), top["pad"]),
                    F.when(top["fresh"], marker).otherwise(F.repeat(F.lit(" "), _marker_width(top))), b["md"])
    lone = F.concat(F.lit("\n\n"), F.when(b["tag"] == "li", "- ").otherwise(""), b["md"])
    used = F.concat(F.slice(stack, F.lit(1), F.greatest(depth - 1, F.lit(0))), F.array(F.struct(
        top["kind"].alias("kind"), top["n"].alias("n"), top["pad"].alias("pad"), F.lit(False).alias("fresh")))).cast(_STACK)
    prev = (F.when((depth == 0) & (F.size(s["stack"]) > 0), "block").when(~has, s["prev"]).when(in_item, "item").otherwise("block"))
    return F.struct(_layout(F.when(has & in_item, used).otherwise(stack), s["tables"], s["row"], s["col"], prev).alias("state"),
                    F.when(~has, "").when(in_item, item).otherwise(lone).alias("out"))


def _layout(stack, tables, row, col_, prev) -> Column:
    return F.struct(stack.alias("stack"), tables.cast("int").alias("tables"), row.cast("int").alias("row"),
                    col_.cast("int").alias("col"), prev.cast("string").alias("prev"))


def _tabled(s: Column, b: Column) -> Column:
    """A stretch inside a table, or a tag that opens one: what stands inside a cell is one line of it."""
    tag, zero = b["tag"], F.lit(0)
    outer = s["tables"] == 1
    ends = (outer & tag.isin("tr", "/tr", "/table") | (tag == "/end")) & (s["col"] > 0)
    row_end = F.concat(F.lit(" |"), F.when(s["row"] == 1, F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), s["col"]))).otherwise(""))
    cell = outer & tag.isin("td", "th") & b["inside"]
    text = F.replace(b["flat"], F.lit("|"), F.lit("\\|"))
    has = text != ""
    first = F.when(s["col"] > 0, " | ").when(s["row"] > 0, "\n| ").otherwise("\n\n| ")
    more = F.concat(F.when(s["prev"] == "cell", " ").otherwise(""), text)
    row = F.when((tag == "table") & (s["tables"] == 0), zero).when(cell & (s["col"] == 0), s["row"] + 1).otherwise(s["row"])
    tables = F.when(tag == "table", s["tables"] + 1).when(tag == "/table", F.greatest(s["tables"] - 1, zero)).otherwise(s["tables"])
    at = F.when(ends | ((tag == "table") & (s["tables"] == 0)), zero).when(cell, s["col"] + 1).otherwise(s["col"])
    outside = has & (s["col"] == 0) & ~cell  # a caption, or text between rows
    prev = F.when(cell, F.when(has, "cell").otherwise("empty")).when(at == 0, "block").when(has, "cell").otherwise(s["prev"])
    out = (F.when(cell, F.concat(first, text))
           .when(ends, F.concat(row_end, F.when(has, F.concat(F.lit("\n\n"), b["md"])).otherwise("")))
           .when(outside, F.concat(F.lit("\n\n"), b["md"])).when(has, more).otherwise(""))
    # Text between the rows parts the table: what follows it is a table of its own.
    return F.struct(_layout(s["stack"], tables, F.when(outside | ends & has, zero).otherwise(row), at, prev).alias("state"), out.alias("out"))


def nested_markdown(html, best: bool = True, references: str = "html5") -> Column:
    """TXT11: Markdown with nested and numbered lists and with tables, of the best contiguous blocks or of all.

    One fold over the page's stretches carries the stack of open lists and the place in the open table, so the work grows
    with the page. Lists and tables inside a cell become text of the cell; a first row is the head of its table.
    """
    def bounds(blocks: Column) -> Column:
        if not best:
            return F.struct(F.lit(0).alias("first"), F.lit(1 << 30).alias("last"))
        return let(F.filter(blocks, lambda b: b["text"] != ""), lambda held: let(best_range(held), lambda r: F.struct(
            F.get(held, r["first"] - 1)["idx"].alias("first"), F.get(held, r["last"] - 1)["idx"].alias("last"))))

    def marked(blocks: Column) -> Column:
        def one(b: Column, r: Column) -> Column:
            inside = F.coalesce(b["idx"].between(r["first"], r["last"]), F.lit(False))
            return F.struct(b["tag"].alias("tag"), inside.alias("inside"), F.when(inside, b["flat"]).otherwise("").alias("flat"),
                            F.when(inside, b["md"]).otherwise("").alias("md"))

        end = F.struct(F.lit("/end").alias("tag"), F.lit(False).alias("inside"), F.lit("").alias("flat"), F.lit("").alias("md"))
        return let(bounds(blocks), lambda r: F.concat(F.transform(blocks, lambda b: one(b, r)), F.array(end)))

    def step(s: Column, b: Column) -> Column:
        in_table = (s["tables"] > 0) | (b["tag"] == "table")
        return F.when(in_table, _tabled(s, b)).otherwise(let(_lists(s["stack"], b), lambda stack: _listed(s, stack, b)))

    start = _layout(F.array().cast(_STACK), F.lit(0), F.lit(0), F.lit(0), F.lit("block"))
    parts = let(_structure(html, references), lambda blocks: scan(marked(blocks), start, "string", step))
    return F.ltrim(F.array_join(parts, ""), F.lit("\n"))


def prune_score(b: Column) -> Column:
    """Text share of the block's markup x (1 - link density) x tag weight."""
    weights = F.create_map(*[F.lit(x) for pair in TAG_WEIGHTS.items() for x in pair])
    share = b["chars"] / F.greatest(b["html_chars"], F.lit(1))
    weight = F.coalesce(F.try_element_at(weights, b["tag"]), F.lit(0.5))
    return F.round(share * (1 - F.least(link_density(b), F.lit(1.0))) * weight, 6)


def pruned(blocks, threshold: float = 0.5, threshold_type: str = "fixed") -> Column:
    """TXT12: blocks scoring at least the threshold; ``dynamic`` uses the page's own mean score."""
    blocks = col(blocks)
    if threshold_type == "fixed":
        return F.filter(blocks, lambda b: prune_score(b) >= threshold)
    total = F.aggregate(blocks, F.lit(0.0), lambda acc, b: acc + prune_score(b))
    limit = F.round(total / F.greatest(F.size(blocks), F.lit(1)), 6)
    return let(limit, lambda lim: F.filter(blocks, lambda b: prune_score(b) >= lim))


def tokens(text) -> Column:
    # The one letter whose lower case is two characters, of which the second would part its word.
    return F.filter(F.split(F.lower(F.replace(col(text), F.lit("\u0130"), F.lit("i"))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25_scores(blocks, query: str, k1: float = 1.2, b: float = 0.75) -> Column:
    """TXT13: array of (idx, score) - BM25 of each block against the query, within its page."""
    words = list(dict.fromkeys(_query_words(query)))
    bags = F.transform(col(blocks), lambda x: F.struct(x["idx"].alias("idx"), tokens(x["text"]).alias("terms")))

    def env(bags: Column) -> Column:
        n = F.size(bags)
        mean = F.aggregate(bags, F.lit(0.0), lambda acc, x: acc + F.size(x["terms"])) / F.greatest(n, F.lit(1))

        def idf(w: str) -> Column:
            df = F.size(F.filter(bags, lambda y: F.array_contains(y["terms"], F.lit(w))))
            return F.log(1 + (n - df + 0.5) / (df + 0.5))

        return F.struct(mean.alias("mean"), F.array(*[idf(w) for w in words]).cast("array<double>").alias("idf"))

    def score(x: Column, e: Column) -> Column:
        total = F.lit(0.0)
        for i, w in enumerate(words):
            tf = F.size(F.filter(x["terms"], lambda t: t == w))
            # Where all blocks are of signs only the share of their mean length is 0 / 0: no number, and above any limit.
            share = F.when(e["mean"] > 0, F.size(x["terms"]) / e["mean"]).otherwise(float("nan"))
            norm = k1 * (1 - b + b * share)
            total = total + F.get(e["idf"], F.lit(i)) * tf * (k1 + 1) / (tf + norm)
        return F.round(total, 6)

    return let(bags, lambda bs: let(env(bs), lambda e: F.transform(
        bs, lambda x: F.struct(x["idx"].alias("idx"), score(x, e).alias("score")))))


def query_counts(blocks, words: list[str]) -> Column:
    """Per block: idx, its number of words, and how often each query word stands in it. No text is left."""
    def count(ts: Column, w: str) -> Column:
        return F.size(F.filter(ts, lambda t: t == w)).cast("long")

    return F.transform(col(blocks), lambda x: let(tokens(x["text"]), lambda ts: F.struct(
        x["idx"].alias("idx"), F.size(ts).cast("long").alias("length"),
        F.array(*[count(ts, w) for w in words]).cast("array<bigint>").alias("tf"))))


def _query_words(query: str) -> list[str]:
    word, out = "", []
    for ch in query.lower() + " ":
        if ch.isalnum():
            word += ch
        elif word:
            out.append(word)
            word = ""
    return out
