"""Quality predicates (Q1-Q6, Q8, Q10, Q11, Q13)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R
from ..rules import DEFAULT_RULES, Rules
from .common import any_of, col, contains_any, let, str_array, strip_ws
from .text import SCRIPT_BODY, STYLE_BODY, drop_up_to, strip_tags

# Failure reasons (fixed values).
PAGE_NOT_LOADED = "PAGE_NOT_LOADED"
PAGE_PARTIAL_LOAD = "PAGE_PARTIAL_LOAD"
BLOCKED_VERIFICATION = "BLOCKED_VERIFICATION"
BLOCKED_ACCESS_DENIED = "BLOCKED_ACCESS_DENIED"
BLOCKED_CLOUDFLARE = "BLOCKED_CLOUDFLARE"
REQUIRE_JAVASCRIPT = "REQUIRE_JAVASCRIPT"
TIMEOUT = "TIMEOUT"

# File signatures as hexadecimal prefixes (fixed values).
MAGIC = (("255044462D", "PDF"), ("89504E47", "PNG"), ("474946383761", "GIF"), ("474946383961", "GIF"),
         ("FFD8FF", "JPEG"), ("504B0304", "ZIP"), ("1F8B", "GZIP"), ("424D", "BMP"), ("00000100", "ICO"))


def magic_type(body) -> Column:
    """Q1: type by file signature, '' when unknown (prefix match: D14)."""
    head = F.hex(F.substring(col(body), 1, 8))
    out = F.lit("")
    for prefix, name in reversed(MAGIC):
        out = F.when(head.startswith(prefix), F.lit(name)).otherwise(out)
    return out


def ascii_printable_ratio(text) -> Column:
    """Q2: share of printable ASCII characters; an empty text counts as fully printable."""
    text = col(text)
    n, bad = F.length(text), F.length(F.regexp_replace(text, r"[\x20-\x7E\t\n\r\x0B\f]", ""))
    return F.when(n > 0, (n - bad) / n).otherwise(F.lit(1.0))


def unicode_printable_ratio(text) -> Column:
    """Q2: share of characters that are neither control characters nor U+FFFD."""
    text = col(text)
    n, good = F.length(text), F.length(F.regexp_replace(
        text, r"[\x{00}-\x{08}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{FFFD}]", ""))
    return F.when(n > 0, good / n).otherwise(F.lit(1.0))


def is_probably_binary(text, min_len: int = 50, threshold: float = 0.90, mode: str = "unicode") -> Column:
    """Q2: long enough and too few printable characters. ``mode="ascii"`` gives the narrower ratio."""
    ratio = unicode_printable_ratio(text) if mode == "unicode" else ascii_printable_ratio(text)
    return F.coalesce((F.length(col(text)) >= min_len) & (ratio < threshold), F.lit(False))


def lane_gate(plain_text, body, cleaned_length=None, text_limit: int = 150, mode: str = "unicode") -> Column:
    """Q3: error of the fast lane's quality gate, NULL when the page may pass."""
    binary = (magic_type(body) != "") | is_probably_binary(plain_text, mode=mode)
    if cleaned_length is None:
        short, name = F.coalesce(F.length(col(plain_text)), F.lit(0)) < text_limit, "plain_text_too_short"
    else:
        short, name = F.coalesce(col(cleaned_length), F.lit(0)) < text_limit, "cleaned_text_too_short"
    return (F.when(F.coalesce(binary, F.lit(False)), "quality_check_failed(binary_or_garbled_detected)")
            .when(short, f"quality_check_failed({name})"))


def reason_from_status(status) -> Column:
    """Q4."""
    return (F.when(col(status).isin(401, 403), BLOCKED_ACCESS_DENIED)
            .when(col(status) == 429, BLOCKED_VERIFICATION))


def reason_from_text(text, html=None) -> Column:
    """Q5: ordered keyword rules. Block words count below 500 characters only, timeout words below 300,
    "too short" words at any length (D16)."""
    text = col(text)
    markup = None if html is None else F.when(F.length(text) < 500, F.lower(F.coalesce(col(html), F.lit(""))))

    # Above 500 characters only these terms count: one look at the text as it is, for those that hold no other.
    apart = [t for t in R.TOO_SHORT_TERMS if not any(o != t and o in t for o in R.TOO_SHORT_TERMS)]
    too_short = text.rlike("(?iu)" + "|".join(map(re.escape, apart)))

    def verdict(e: Column) -> Column:
        low, n = e["low"], e["n"]
        cloudflare, blocked = contains_any(low, R.CLOUDFLARE_TERMS), contains_any(low, R.BLOCK_TERMS)
        if markup is not None:
            cloudflare = cloudflare | e["markup"].contains("cloudflare")
            blocked = blocked | contains_any(e["markup"], R.BLOCK_TERMS)
        return (F.when((n == 0) | n.isNull(), F.lit(None).cast("string"))
                .when((n < 500) & cloudflare, BLOCKED_CLOUDFLARE)
                .when((n < 500) & contains_any(low, R.REQUIRE_JS_TERMS), REQUIRE_JAVASCRIPT)
                .when((n < 500) & blocked, BLOCKED_VERIFICATION)
                .when((n < 300) & contains_any(low, R.TIMEOUT_TERMS), TIMEOUT)
                .when(F.when(n < 500, contains_any(low, R.TOO_SHORT_TERMS)).otherwise(e["short"]), PAGE_PARTIAL_LOAD))

    long = F.length(text) >= 500
    parts = [F.when(~long, F.lower(text)).alias("low"), F.length(text).alias("n"), F.when(long, too_short).alias("short")]
    if markup is not None:
        parts.append(markup.alias("markup"))
    return let(F.struct(*parts), verdict)


def health_facts(text) -> Column:
    """All that Q6 needs of a text (its length and the reason found in it), so that a text many attempts brought is read once."""
    return let(strip_ws(F.coalesce(col(text), F.lit(""))), lambda t: F.struct(
        F.length(t).alias("n"), reason_from_text(t).alias("reason")))


def content_health(text, status=None, min_len: int = 150) -> Column:
    """Q6: health verdict struct - status first, then text, then emptiness, then length."""
    return let(health_facts(text), lambda e: health_of(e, status, min_len))


def health_of(facts, status=None, min_len: int = 150) -> Column:
    """Q6 from :func:`health_facts`."""
    facts = col(facts)
    status = F.lit(None).cast("int") if status is None else col(status).cast("int")
    n = facts["n"]
    hit = F.coalesce(
        F.concat(F.lit("status_code|"), reason_from_status(status)),
        F.concat(F.lit("blocked_keywords|"), facts["reason"]),
        F.when(n == 0, f"empty_text|{PAGE_NOT_LOADED}").when(n < min_len, f"partial_text|{PAGE_PARTIAL_LOAD}"))

    def verdict(e: Column) -> Column:
        return F.struct(e["hit"].isNull().alias("ok"), F.substring_index(e["hit"], "|", -1).alias("reason"),
                        F.substring_index(e["hit"], "|", 1).alias("hit"), e["n"].alias("text_length"),
                        F.lit(min_len).alias("min_text_length"), status.alias("status_code"))

    return let(F.struct(n.alias("n"), hit.alias("hit")), verdict)


def probe_facts(html) -> Column:
    """All that Q8 needs of a body: its length without tags and whether it holds words of a block page."""
    html = F.coalesce(col(html), F.lit(""))

    def seen(t: Column) -> Column:
        blocked = (t != "") & (contains_any(html, R.PROBE_INDICATORS) | contains_any(t, R.PROBE_INDICATORS))
        return F.struct(F.length(t).alias("n"), blocked.alias("blocked"))

    return let(strip_ws(strip_tags(html)), seen)


def probe_verdict(success, status, html, min_len: int = 100) -> Column:
    """Q8: is the recorded probe of the cheap lane good enough? Failure reasons in fixed order."""
    return probe_of(success, status, probe_facts(html), min_len)


def probe_of(success, status, facts, min_len: int = 100) -> Column:
    """Q8 from :func:`probe_facts`."""
    ok, code = F.coalesce(col(success), F.lit(False)), F.coalesce(col(status).cast("int"), F.lit(0))

    def verdict(e: Column) -> Column:
        n, blocked = e["n"], e["blocked"]
        why = F.array_compact(F.array(
            F.when(~ok, "请求失败"),
            F.when(code != 200, F.concat(F.lit("HTTP错误("), code.cast("string"), F.lit(")"))),
            F.when(n < min_len, F.concat(F.lit("文字过少("), n.cast("string"), F.lit("字符)"))),
            F.when(blocked, "检测到拦截/验证")))
        return F.struct((ok & (code == 200) & (n >= min_len) & ~blocked).alias("effective"),
                        n.alias("text_length"), blocked.alias("blocked"), why.alias("failure_reasons"))

    return let(col(facts), verdict)


def cause_in_text(markdown, html_text) -> Column:
    """What Q9 reads from the text of a lane: the cause that its block words name, NULL if it holds none."""
    text = F.lower(F.concat_ws(" ", F.coalesce(col(markdown), F.lit("")), F.coalesce(col(html_text), F.lit(""))))
    return let(text, lambda t: F.when(contains_any(t, R.LANE_CLOUDFLARE_TERMS), "Cloudflare 人机验证拦截")
               .when(contains_any(t, R.LANE_VERIFY_TERMS), "需要人机验证"))


def lane_failure_cause(lane, error, by_text, status, text_length=None) -> Column:
    """Q9: why a lane failed - its own error, else block words (:func:`cause_in_text`), else status (browser lane), else short text."""
    short = F.coalesce(col(text_length), F.lit(0)) if text_length is not None else F.lit(0)
    rest = (F.when((col(lane) == "playwright") & (col(status) >= 400),
                  F.concat(F.lit("页面访问失败，状态码: "), col(status).cast("string")))
            .when(col(lane) == "jina", "失败，未知原因")
            .otherwise(F.concat(F.lit("质量检查失败(文本长度: "), short.cast("string"), F.lit(")"))))
    return F.when(F.coalesce(col(error), F.lit("")) != "", col(error)).otherwise(F.coalesce(col(by_text), rest))


def http_error(status) -> Column:
    """Q10: message for a status of 400 or more, NULL below."""
    s = col(status)
    suffix = (F.when(s == 404, " (页面不存在)").when(s == 403, " (访问被禁止)")
              .when(s >= 500, " (服务器错误)").otherwise(""))
    return F.when(s >= 400, F.concat(F.lit("页面访问失败，状态码: "), s.cast("string"), suffix))


def status_from_error(error) -> Column:
    """Q13: status code quoted in an error message."""
    return F.regexp_extract(col(error), r"状态码[：:]\s*([0-9]+)", 1).try_cast("int")


def resolved_status(browser_status, browser_error, reader_status) -> Column:
    """Q13: browser lane's status, else the one in its error text, else the reader lane's. 0 counts as absent."""
    def some(c: Column) -> Column:
        return F.when(c != 0, c)

    return F.coalesce(some(col(browser_status).cast("int")), some(status_from_error(browser_error)),
                      col(reader_status).cast("int"))


# Characters a framework script name can hold. Matching whole runs of them from their start only
# (look-behind) keeps the search linear, also on long base64 runs.
_NAME = r"[A-Za-z0-9.@/\\-]"
_SCRIPT_NAMES = rf"(?i)(?<!{_NAME}){_NAME}*\.(?:js|css)"
# Patterns that can match such characters only.
_NAME_PATTERN = re.compile(r"(?:[A-Za-z0-9@/]|\\[.d/\\-]|\[[A-Za-z0-9.@/\\-]+\]|\(\?:|[()|?*+-])+\\\.(?:js|css)")


def _spells_file_name(pattern: str) -> bool:
    depth, bars = 0, []
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|":
            bars.append(depth)
    return bool(_NAME_PATTERN.fullmatch(pattern)) and 0 not in bars


def framework_scripts(html, rules: Rules = DEFAULT_RULES) -> Column:
    """Does the page name a front-end framework script?

    Patterns that spell out a file name ending in ``.js`` or ``.css`` match inside such names only, so the long
    alternation of them runs over the names found, not over the page. Any other pattern runs over the page.
    """
    html = col(html)
    named = [p for p in rules.spa_patterns if _spells_file_name(p)]
    at = [p for p in rules.spa_patterns if p not in named]
    hits = []
    if named:
        names = F.array_join(F.regexp_extract_all(html, F.lit(_SCRIPT_NAMES), F.lit(0)), " ")
        hits.append(names.rlike("(?i)" + "|".join(named)))
    if at:
        hits.append(html.rlike("(?i)" + "|".join(at)))
    return any_of(hits)


def spa_fingerprint(html, rules: Rules = DEFAULT_RULES) -> Column:
    """Q11: five weighted criteria; SPA when at least two are met."""
    html = F.coalesce(col(html), F.lit(""))
    low = F.lower(html)
    whole = r"(?s)<body[^>]*>(.*?)</body>"
    body = F.when(low.contains("</body>") & low.rlike(whole), F.regexp_extract(low, whole, 1)).otherwise(low)
    body = strip_tags(drop_up_to(drop_up_to(body, SCRIPT_BODY, "</script>"), STYLE_BODY, "</style>"))
    n_body = F.length(strip_ws(body))
    n_script = F.regexp_count(low, F.lit(r"<script[^>]*>"))
    n_meta = sum((low.contains(m.lower()).cast("int") for m in rules.spa_metas), F.lit(0))
    tags, words = rules.spa_root_tags, rules.spa_root_words
    root = contains_any(low, words) | (low.rlike(tags) if tags else F.lit(False))
    w = rules.spa_weights
    met = F.array_compact(F.array(
        F.when(n_body < rules.body_text_threshold, "empty_body"),
        F.when(n_script >= rules.script_count_threshold, "high_script_count"),
        F.when(framework_scripts(html, rules), "spa_framework_scripts"),
        F.when(root, "spa_root_container"),
        F.when(n_meta > 2, "meta_indicators")))
    weights = F.create_map(*[F.lit(x) for pair in w.items() for x in pair])

    def verdict(names: Column) -> Column:
        score = F.aggregate(names, F.lit(0), lambda acc, name: acc + F.element_at(weights, name))
        return F.struct(names.alias("criteria_matched"), F.least(score, F.lit(100)).alias("confidence"),
                        (F.size(names) >= rules.min_criteria_match).alias("is_spa"))

    return let(met, verdict)


def selector_hits(html, rules: Rules = DEFAULT_RULES) -> Column:
    """Q12: how many of the listed selectors occur in the page's tags.

    Plain classes and ids are looked up among the values that tags carry, all in one pass each; the few others are
    searched for as attributes.
    """
    html = F.coalesce(col(html), F.lit(""))
    parts = [R.selector_parts(s) for s in rules.block_selectors]

    def values(attr: str) -> Column:
        found = F.regexp_extract_all(html, F.lit(rf"""(?i)<[a-z][^<>]*\s{attr}\s*=\s*["']([^"'<>]*)["']"""), F.lit(1))
        return F.split(F.lower(F.array_join(found, " ")), r"\s+")

    hits = F.lit(0)
    for attr in ("class", "id"):
        plain = [p[3] for p in parts if p[0] == attr and not p[1]]
        if plain:
            hits = hits + F.size(F.array_intersect(values(attr), str_array(plain)))
    for kind, tag, attr, value, match in parts:
        if kind == "attr" or tag:
            inner = {"part": rf"""[^"'<>]*{re.escape(value)}""", "whole": rf"""{re.escape(value)}["']""",
                     "word": rf"""(?:[^"'<>]*\s)?{re.escape(value)}[\s"']"""}[match]
            hits = hits + html.rlike(rf"""(?i)<{tag or '[a-z][a-z0-9]*'}\b[^<>]*\s{attr}\s*=\s*["']{inner}""").cast("int")
    return hits


def block_term_hits(text, title, url, html=None, rules: Rules = DEFAULT_RULES) -> Column:
    """Q12: array of (section, language, hits) - how many listed terms occur in each part of the page.

    The term lists are bounded literals, so no join is needed. Services are looked for in the text; with ``html``
    there is also a row for the selectors.
    """
    where = {"text": text, "title": title, "url": url, "service": text}

    def hits(section: str, words) -> Column:
        hay = F.lower(F.coalesce(col(where[section]), F.lit("")))
        return let(hay, lambda h: F.size(F.filter(str_array(words), lambda t: F.contains(h, t))))

    rows = [F.struct(F.lit(s).alias("section"), F.lit(lang).alias("language"), hits(s, words).alias("hits"))
            for (s, lang), words in sorted(rules.block_terms.items())]
    if html is not None:
        rows.append(F.struct(F.lit("selector").alias("section"), F.lit("any").alias("language"), selector_hits(html, rules).alias("hits")))
    return F.array(*rows)
