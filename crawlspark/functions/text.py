"""HTML and Markdown text expressions (TXT1-TXT10, TXT14, TXT15, TXT17, TXT19)."""

from __future__ import annotations

from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col, collapse_ws, last_or_null, let, str_array, strip_ws
from .urls import absolute_link, authority, scheme

NO_TITLE = "无标题"  # fixed value

# Element patterns. Bodies are matched by a lazy run, not by alternation per character:
# java.util.regex recurses on the latter and overflows the stack on a 2 KB script.
SCRIPT_BODY = r"(?is)<script[^>]*>.*?</script>"
STYLE_BODY = r"(?is)<style[^>]*>.*?</style>"
NOSCRIPT_BODY = r"(?is)<noscript[^>]*>.*?</noscript>"


def drop_up_to(html, pattern: str, last: str, with_: str = "") -> Column:
    """Replace matches of ``pattern``, all of which end with ``last``.

    Only the text up to its last occurrence can hold a match. Beyond it each opening tag would send the regex to the
    end of the text in vain, which is quadratic on a page of unclosed tags.
    """
    def cut(t: Column) -> Column:
        head = F.regexp_extract(t, rf"(?is)^(.*{last})", 1)
        return let(head, lambda h: F.when(h == "", t).otherwise(
            F.concat(F.regexp_replace(h, pattern, with_), F.substring(t, F.length(h) + 1, F.length(t)))))

    return let(col(html), cut)


def strip_tags(html, with_: str = "", pattern: str = r"<[^>]+>") -> Column:
    """Replace tags. Only the text up to the last ``>`` can hold one; beyond it every ``<`` would send the regex
    to the end of the text and back, which is quadratic on prose or code full of ``<``."""
    def cut(t: Column) -> Column:
        tail = F.substring_index(t, ">", -1)
        head = F.substring(t, F.lit(1), F.length(t) - F.length(tail))
        return F.concat(F.regexp_replace(head, pattern, with_), tail)

    return let(col(html), cut)


def visible_text(html) -> Column:
    """TXT1: text without script, style and tags; white space collapsed."""
    bare = drop_up_to(drop_up_to(html, SCRIPT_BODY, "</script>"), STYLE_BODY, "</style>")
    return collapse_ws(strip_tags(bare))


def probe_text(html, spaced: bool = True) -> Column:
    """TXT2: tags become spaces (or vanish), over the whole text."""
    html = col(html)
    return collapse_ws(strip_tags(html, " ")) if spaced else strip_ws(strip_tags(html))


# Names of character references, from the standard library's HTML5 table; LEGACY are those that need no semicolon.
LEGACY = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
# One literal text for each initial, ``;name=value`` and a zero: planning rules would walk through a map of thousands.
_INITIALS = [chr(c) for c in range(ord("A"), ord("z") + 1)]
_TABLES = ["".join(f";{n[:-1]}={html5[n]}\0" for n in sorted(html5) if n[0] == i and n.endswith(";")) for i in _INITIALS]
# Numbers 0x80 to 0x9F mean what they are in windows-1252, where it has a character.
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_C1_READ = "".join(bytes([c]).decode("cp1252") if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(c) for c in range(0x80, 0xA0))


def _numbered(number: Column) -> Column:
    """The character of a number: U+FFFD for none, nothing for those that are no characters of a document."""
    number = F.when((number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), 0xFFFD).otherwise(number)
    void = (number.between(1, 8) | (number == 0x0B) | number.between(0x0E, 0x1F) | (number == 0x7F)
            | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE))
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(void, "").otherwise(F.translate(char, _C1, _C1_READ))


def _named(name: Column) -> Column:
    """The characters that a name stands for; NULL if it is none."""
    table = F.get(F.array(*map(F.lit, _TABLES)), F.ascii(name) - ord("A"))
    return let(table, lambda t: let(F.position(F.concat(F.lit(";"), name, F.lit("=")), t), lambda at: F.when(
        at > 0, F.substring_index(F.substring(t, at + F.length(name) + 2, F.lit(4)), "\0", 1))))


# The references of the ``basic`` reading, the ampersand's last so that each is decoded once (fixed values).
BASIC_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(c, references: str = "html5") -> Column:
    """Character references as HTML5 reads them: named ones, those without a semicolon too, and numeric ones.

    Each is decoded once: what decoding yields is not looked at again. ``references="basic"`` reads those of
    ``BASIC_REFERENCES`` only, and none without its semicolon: a title cut off at ``&amp`` keeps it.
    """
    if references == "basic":
        return let(col(c), lambda t: F.when(t.contains("&"), reduce(
            lambda out, pair: F.replace(out, F.lit(pair[0]), F.lit(pair[1])), BASIC_REFERENCES, t)).otherwise(t))
    if references != "html5":
        raise ValueError(f"unknown reading of references: {references}")

    def but(part: Column, held: Column) -> Column:
        return F.substring(part, F.length(held) + 1, F.length(part))

    def numeric(part: Column) -> Column:
        def read(held: Column) -> Column:
            value = F.regexp_replace(held, "^#[xX]?0*|;$", "")
            number = F.when(value == "", 0).when(F.length(value) > 8, 0x110000).otherwise(
                F.when(held.rlike("^#[xX]"), F.conv(value, 16, 10)).otherwise(value).try_cast("long"))
            return F.when(held == "", F.concat(F.lit("&"), part)).otherwise(F.concat(_numbered(number), but(part, held)))

        return let(F.regexp_extract(part, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0), read)

    def legacy(part: Column) -> Column:
        return let(F.regexp_extract(part, f"^(?:{'|'.join(LEGACY)})", 0), lambda held: F.when(
            held == "", F.concat(F.lit("&"), part)).otherwise(F.concat(_named(held), but(part, held))))

    def named(part: Column) -> Column:
        whole = F.regexp_extract(part, "^([A-Za-z][A-Za-z0-9]{1,31});", 1)
        return let(whole, lambda n: let(F.when(n != "", _named(n)), lambda chars: F.when(
            chars.isNotNull(), F.concat(chars, F.substring(part, F.length(n) + 2, F.length(part)))).otherwise(legacy(part))))

    def decoded(part: Column) -> Column:
        return F.when(part.startswith("#"), numeric(part)).otherwise(named(part))

    def whole(t: Column) -> Column:
        joined = let(F.split(t, "&"), lambda parts: F.concat(
            F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), decoded), "")))
        return F.when(t.contains("&"), joined).otherwise(t)

    return let(col(c), whole)


def html_title(html, default: str | None = NO_TITLE, references: str = "html5") -> Column:
    """TXT3: first ``<title>``, unescaped and collapsed."""
    held = F.regexp_extract(col(html), r"(?is)^(.*</title>)", 1)  # beyond it no title ends
    # If none ends behind the first tag, none ends behind a later one: the first alone is tried.
    title = collapse_ws(unescape(F.regexp_extract(held, r"(?is)^(?>.*?<title)[^>]*+>(.*?)</title>", 1), references))
    return title if default is None else F.when(title == "", default).otherwise(F.coalesce(title, F.lit(default)))


def markdown_title(md) -> Column:
    """TXT4: first title-like line - ``Title:``, the line above a separator (D21), ``# ``, ``## `` -
    else the first line that is no meta line."""
    rule = "=" * 15

    def pick(lines: Column) -> Column:
        def above(i: Column) -> Column:
            return last_or_null(F.filter(F.slice(lines, F.lit(1), i), lambda p: (p != "") & (p != rule)))

        found = F.transform(lines, lambda s, i: (
            F.when(s.startswith("Title:"), strip_ws(F.substring(s, 7, 1 << 30)))
            .when(s == rule, above(i))
            .when(s.startswith("# "), strip_ws(F.substring(s, 3, 1 << 30)))
            .when(s.startswith("## "), strip_ws(F.substring(s, 4, 1 << 30)))))
        plain = F.filter(lines, lambda s: ((s != "") & ~s.startswith("URL Source:")
                                           & ~s.startswith("Markdown Content:")))
        return F.coalesce(F.get(F.filter(found, lambda t: t.isNotNull()), F.lit(0)),
                          F.get(plain, F.lit(0)), F.lit(""))

    return let(F.transform(F.split(F.coalesce(col(md), F.lit("")), "\n"), strip_ws), pick)


def strip_base64_images(html) -> Column:
    """TXT5: inline images in ``<img>``, CSS ``url()`` and bare form. One test spares pages without any.

    Patterns and replacement texts are fixed values, as are those of :func:`strip_base64_markdown`.
    """
    html = col(html)
    out = F.regexp_replace(html, r"""(?i)<img[^>]*src=["']data:image/[^;]+;base64,[^"']*["'][^>]*>""",
                           "<!-- base64-img-removed -->")
    out = F.regexp_replace(out, r"""(?i)url\(["']?data:image/[^;]+;base64,[^)]+\)""", "url(#base64-removed)")
    out = F.regexp_replace(out, r"(?i)data:image/[a-zA-Z]+;base64,[A-Za-z0-9+/=]+", "#base64-removed")
    return F.when(html.rlike("(?i);base64,"), out).otherwise(html)


def strip_base64_markdown(md) -> Column:
    """TXT6: inline images in Markdown image, link and bare form."""
    # No class runs over another opening bracket, so each place is looked at from few starts.
    out = F.regexp_replace(col(md), r"(?i)!\[([^\[\]]*)\]\(data:image/[^;()\[\]]+;base64,[^()\[\]]+\)", "![图片已移除]")
    out = F.regexp_replace(out, r"(?i)\[[^\[\]]*\]\(data:image/[^;()\[\]]+;base64,[^()\[\]]+\)", "[base64-link-removed]")
    return F.regexp_replace(out, r"(?i)data:image/[a-zA-Z]+;base64,[A-Za-z0-9+/=]+", "#base64-removed")


def strip_script_style(html) -> Column:
    """TXT7: script, style and noscript elements, then self-closed script and style tags."""
    out = col(html)
    for pattern, last in ((SCRIPT_BODY, "</script>"), (STYLE_BODY, "</style>"), (NOSCRIPT_BODY, "</noscript>"),
                          (r"(?i)<script[^>]*/>", "/>"), (r"(?i)<style[^>]*/>", "/>")):
        out = drop_up_to(out, pattern, last)
    return out


def strip_md_links(md, images: bool = True, links: bool = True) -> Column:
    """TXT8: drop Markdown images and/or links, label included.

    A link lies in a line. Each line is searched up to the first ``)`` after the last ``](`` that has one behind it: before
    that ``](`` every bracket opens a match, which is then passed over; behind it none does.
    """
    def without(pattern: str):
        def one(line: Column) -> Column:
            closed = F.substring(line, F.lit(1), F.length(line) - F.length(F.substring_index(line, ")", -1)))

            def cut(h: Column) -> Column:
                rest = F.substring_index(h, "](", -1)
                size = F.length(h) - F.length(rest) + F.locate(")", rest)
                return F.when(~h.contains("]("), line).otherwise(let(size, lambda n: F.concat(
                    F.regexp_replace(F.substring(line, F.lit(1), n), pattern, ""), F.substring(line, n + 1, F.length(line)))))

            return let(closed, cut)

        return one

    lines = F.split(col(md), "\n")
    if images:
        lines = F.transform(lines, without(r"!\[[^\n]*?\]\([^\n]*?\)"))
    if links:
        lines = F.transform(lines, without(r"(?<!!)\[[^\n]*?\]\([^\n]*?\)"))
    return F.array_join(lines, "\n")


ICON_RELS = ("icon", "shortcut icon", "apple-touch-icon", "apple-touch-icon-precomposed")  # fixed order


def icon_links(html, base, k: int = 3) -> Column:
    """TXT9: up to ``k`` absolute icon links from the whole document, else ``/favicon.ico``."""
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    tags = F.regexp_extract_all(col(html), F.lit(r"(?is)<link\b[^<>]*>"), F.lit(0))

    def attr(tag: Column, name: str) -> Column:
        return F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", 1)

    def of_rel(links: Column, rel: str) -> Column:
        return F.transform(F.filter(links, lambda x: (x["rel"] == rel) & (x["href"] != "")), lambda x: x["href"])

    links = F.transform(tags, lambda t: F.struct(F.lower(attr(t, "rel")).alias("rel"), attr(t, "href").alias("href")))
    hrefs = let(links, lambda ls: F.slice(F.concat(*[of_rel(ls, rel) for rel in ICON_RELS]), 1, k))
    return let(hrefs, lambda hs: F.transform(
        F.when(F.size(hs) > 0, hs).otherwise(str_array(["/favicon.ico"])), lambda h: absolute_link(root, h)))


def has_pdf_embed(html) -> Column:
    """TXT10: an embed or object of PDF type, or a frame whose source is a PDF."""
    html = col(html)
    return (html.rlike(r"""(?is)<(?:embed|object)\b[^<>]*\stype\s*=\s*["']application/pdf["']""")
            | html.rlike(r"""(?is)<iframe\b[^<>]*\ssrc\s*=\s*["'][^"'<>]*\.pdf"""))


def is_huge(html, mb: float = 8.0) -> Column:
    """TXT14: document length reaches ``mb`` mebi-characters."""
    return F.coalesce(F.length(col(html)) / F.lit(1024.0 * 1024.0) >= F.lit(float(mb)), F.lit(False))


def split_spans(html, target_kb: int = 512, overlap: int = 1024) -> Column:
    """TXT15: array of (idx, start, end); a cut moves to the next safe boundary within 4096 characters."""
    if target_kb < 64 or overlap < 0:
        raise ValueError("a chunk holds at least 64 KB and an overlap is not negative")
    html = col(html)
    target, overlap = int(target_kb * 1024), int(overlap)
    spans = "array<struct<start:int,end:int>>"

    def cut(i: Column, n: Column) -> Column:
        j = F.least(n, i + target)
        window = F.substring(html, j + 1, F.lit(4096))
        return (j + F.length(F.regexp_extract(window, r"(?s)^.*?(?:</p>|</div>|\n\n)", 0))).cast("int")

    def step(acc: Column, _: Column) -> Column:
        n = acc["n"]
        nxt = cut(acc["i"], n)
        span = F.struct(F.greatest(F.lit(0), acc["i"] - overlap).alias("start"),
                        F.least(n, nxt + overlap).alias("end"))
        grown = F.struct(n.alias("n"), nxt.alias("i"), F.concat(acc["spans"], F.array(span)).alias("spans"))
        return F.when(acc["i"] >= n, acc).otherwise(grown)

    n = F.coalesce(F.length(html), F.lit(0))
    start = F.struct(n.alias("n"), F.lit(0).alias("i"), F.array().cast(spans).alias("spans"))
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(n / F.lit(float(target))).cast("int")))
    out = F.aggregate(steps, start, step)["spans"]
    return F.transform(F.coalesce(out, F.array().cast(spans)),
                       lambda s, i: F.struct(i.alias("idx"), s["start"].alias("start"), s["end"].alias("end")))


def reduction_pct(original, cleaned) -> Column:
    """Percentage saved, never below zero, two decimals."""
    o, c = col(original).cast("double"), col(cleaned).cast("double")
    return F.greatest(F.lit(0.0), F.round((o - c) / F.greatest(F.lit(1.0), o) * 100, 2))


def cleaning_stats(html, cleaned) -> Column:
    """TXT17: sizes before and after, plain text length, reduction."""
    o, c = F.length(col(html)), F.length(col(cleaned))
    return F.struct(o.alias("original_size"), c.alias("cleaned_size"),
                    F.length(probe_text(cleaned)).alias("text_length"),
                    reduction_pct(o, c).alias("reduction_percentage"))


def failure_markdown(url, easyget_error=None, playwright_error=None, jina_error=None, pdf_error=None) -> Column:
    """TXT19: the body reported for a request that failed on every lane; its wording is a fixed value."""
    parts = [F.when(col(e) != "", F.concat(F.lit(f"{label}: "), col(e)))
             for label, e in (("EasyGet", easyget_error), ("Playwright", playwright_error), ("Jina", jina_error), ("PDF", pdf_error))
             if e is not None]
    causes = F.concat_ws(" | ", *parts) if parts else F.lit("")
    causes = F.when(causes == "", "未知错误").otherwise(causes)
    return F.concat(F.lit("# 爬取失败\n\n**URL:** "), F.coalesce(col(url), F.lit("")),
                    F.lit("\n\n**失败原因:** "), causes)
