"""URL projections and predicates (URL1-URL13). Every function maps columns to a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import DEFAULT_RULES, ENTRY_REWRITES, PDF_HEADER_SITES, PDF_VIEWER_SITES, Rules
from .common import any_of, col, contains_any, str_array

# RFC 3986, appendix B, with a strict scheme; groups: scheme, authority, path, query, fragment.
URI = (r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?"
       r"([^?#]*)(?:\?([^#]*))?(?:#(.*))?$")
UNSAFE_NAME = r'[<>:"/\\|?*]'


def _tidy(url: Column) -> Column:
    """Leading control characters and embedded tabs or line ends are no part of a URL."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def _group(url: Column | str, n: int) -> Column:
    return F.regexp_extract(_tidy(col(url)), URI, n)


def scheme(url) -> Column:
    return F.lower(_group(url, 1))


def authority(url) -> Column:
    return _group(url, 2)


def path(url) -> Column:
    """Path without the ``;params`` of its last segment."""
    return F.regexp_replace(_group(url, 3), r";[^/]*$", "")


def query(url) -> Column:
    return _group(url, 4)


def fragment(url) -> Column:
    return _group(url, 5)


def url_parts(url) -> Column:
    """URL1: struct of scheme, authority (port kept), path, query, fragment."""
    return F.struct(scheme(url).alias("scheme"), authority(url).alias("authority"), path(url).alias("path"),
                    query(url).alias("query"), fragment(url).alias("fragment"))


def strip_www(host) -> Column:
    return F.regexp_replace(F.lower(col(host)), r"^www\.", "")


def norm_host(url) -> Column:
    """URL2: lower-case authority without a leading ``www.`` (prefix, not characters: D1)."""
    return strip_www(authority(url))


def host_variants(host) -> Column:
    """URL3: ``a.b.c`` -> ``[a.b.c, b.c]``; a single label gives an empty array."""
    parts = F.split(col(host), r"\.")
    size = F.size(parts)
    return F.transform(F.slice(parts, F.lit(1), size - 1),
                       lambda _, i: F.array_join(F.slice(parts, i + 1, size), "."))


def host_in(host, hosts) -> Column:
    """Host equals, or is a subdomain of, one of a bounded list of hosts.

    A listed host of k labels can only equal the last k labels, so each label count becomes one hash-set
    test inside codegen: no join, no array, no shuffle.
    """
    host = col(host)
    by_labels: dict[int, list] = {}
    for h in hosts:
        by_labels.setdefault(h.count(".") + 1, []).append(h)
    return any_of(F.substring_index(host, ".", -k).isin(group) for k, group in sorted(by_labels.items()))


def normalize_entry_url(url, rewrites=ENTRY_REWRITES) -> Column:
    """URL4: default scheme, and per-host scheme or host rewrites."""
    url = col(url)
    sch, net = scheme(url), authority(url)
    new_scheme = F.when(sch == "", F.lit("http")).otherwise(sch)
    new_net = net
    for suffix, forced, full in reversed(rewrites):
        new_scheme = F.when(net.endswith(suffix), F.lit(forced)).otherwise(new_scheme)
        new_net = F.when(net == suffix, F.lit(full)).otherwise(new_net)
    rest = F.regexp_extract(_tidy(url), r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?(.*)$", 1)
    slash = F.when((rest != "") & ~rest.rlike(r"^[/?#]"), F.lit("/")).otherwise(F.lit(""))
    same = (new_scheme == sch) & (new_net == net)
    return F.when((net == "") | same, url).otherwise(F.concat(new_scheme, F.lit("://"), new_net, slash, rest))


def url_template(url) -> Column:
    """URL5: the path without a trailing ``*.pdf`` file name."""
    return F.regexp_replace(path(url), r"(?i)/[^/]*\.pdf$", "/")


def _unquote(c: Column) -> Column:
    """Percent-decoding only: ``+`` stays; a malformed name is kept as written."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def _with_pdf(name: Column) -> Column:
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


NAME_LIMIT = 60   # characters of a stem; file systems take 255 bytes
ID_DIGITS = 16    # hex digits of the id


def _safe(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "")


def pdf_filename(url, original=None, style: str = "plain", custom=None) -> Column:
    """URL6: file name for a PDF. ``plain`` keeps the base name, ``site`` uses per-site naming plus an id.

    The id is derived from the URL instead of drawn at random, so a re-run gives the same name. A stem that is cut to
    what a file name may hold always carries the id, a custom one too, so that no two URLs share a name by the cut.
    """
    url = col(url)
    original = F.lit(None).cast("string") if original is None else col(original)
    p, net = path(url), authority(url)
    given = F.coalesce(original, F.lit("")) != ""
    if style == "plain":
        base = F.substring_index(p, "/", -1)
        host = F.regexp_replace(F.when(net == "", "unknown").otherwise(net), UNSAFE_NAME, "_")
        return (F.when(given, _with_pdf(F.regexp_replace(original, UNSAFE_NAME, "_")))
                .when(base != "", _with_pdf(F.regexp_replace(_unquote(base), UNSAFE_NAME, "_")))
                .otherwise(F.concat(host, F.lit(".pdf"))))

    def stem(c: Column) -> Column:
        return F.substring_index(c, ".", 1)

    segments = F.filter(F.split(p, "/"), lambda s: s != "")
    last = F.coalesce(stem(F.try_element_at(segments, F.lit(-1))), F.lit(""))
    parts = F.split(F.regexp_replace(p, "^/+|/+$", ""), "/")
    net_name = F.replace(net, F.lit("."), F.lit("_"))
    name = (
        F.when(given, F.regexp_replace(original, r"(?s)^(.*[^.])\.[^.]*$", "$1"))
        .when(net.contains("arxiv.org") & p.contains("/pdf/"),
              F.concat(F.lit("arxiv_"), stem(F.substring_index(p, "/pdf/", -1))))
        .when(net.contains("arxiv.org"), F.when(F.length(last) >= 3, last).otherwise("arxiv_paper"))
        .when((net.contains("biorxiv.org") | net.contains("medrxiv.org")) & p.contains("/content/"),
              F.concat(F.lit("biorxiv_"), F.substring_index(F.substring_index(p, "/content/", -1), "/", 1)))
        .when(net.contains("biorxiv.org") | net.contains("medrxiv.org"), "biorxiv_paper")
        .when(net.contains("proceedings.mlr.press") & p.contains("/v") & (F.size(parts) >= 3),
              F.concat(F.lit("pmlr_"), F.get(parts, F.lit(0)), F.lit("_"), F.get(parts, F.lit(1))))
        .when(net.contains("proceedings.mlr.press"), "pmlr_paper")
        .otherwise(F.when(F.length(last) >= 3, last).otherwise(net_name))
    )
    safe = _safe(name)
    tag = F.concat(F.lit("_"), F.substring(F.sha2(url, 256), 1, ID_DIGITS), F.lit(".pdf"))
    tagged = F.concat(F.when(safe == "", "pdf_file").otherwise(F.substring(safe, 1, NAME_LIMIT)), tag)
    if custom is None:
        return tagged
    custom = col(custom)
    mine = _safe(custom)
    mine = F.when(F.length(mine) <= NAME_LIMIT, F.concat(mine, F.lit(".pdf"))).otherwise(
        F.concat(F.substring(mine, 1, NAME_LIMIT), tag))
    return F.when(F.coalesce(custom, F.lit("")) != "", mine).otherwise(tagged)


def _direct_pdf(low: Column) -> Column:
    return low.endswith(".pdf") | low.contains(".pdf?") | low.contains(".pdf#")


def url_type(url) -> Column:
    """URL7: ``direct_pdf``, ``pdf_viewer`` or ``unknown``."""
    low = F.lower(col(url))
    return (F.when(_direct_pdf(low), "direct_pdf")
            .when(contains_any(low, PDF_VIEWER_SITES), "pdf_viewer").otherwise("unknown"))


def is_pdf_url(url, rules: Rules = DEFAULT_RULES) -> Column:
    """URL8: ordered PDF rule - extension, the arXiv case, PDF host, substring pattern, query indicator."""
    url = col(url)
    low_path, host, q = F.lower(path(url)), norm_host(url), F.lower(query(url))
    return (F.when(low_path.endswith(".pdf"), True)
            .when(host == "arxiv.org", low_path.contains("/pdf/"))
            .when(host_in(host, rules.pdf_hosts), True)
            .when(contains_any(F.lower(url), rules.pdf_patterns), True)
            .when(q.contains("pdf") & contains_any(q, rules.pdf_query_indicators), True)
            .otherwise(False))


def is_pdf_by_headers(url, headers) -> Column:
    """URL9: extension, content type (a header map), known sites."""
    low = F.lower(col(url))
    content_type = F.lower(F.coalesce(F.try_element_at(col(headers), F.lit("content-type")), F.lit("")))
    return _direct_pdf(low) | content_type.contains("application/pdf") | contains_any(low, PDF_HEADER_SITES)


def is_spa_host(url, rules: Rules = DEFAULT_RULES) -> Column:
    """URL10: the URL's host equals, or lies under, a listed SPA host."""
    return host_in(norm_host(url), rules.spa_hosts)


def pdf_verdict(url, content_type, disposition, embed, magic, status, rules: Rules = DEFAULT_RULES) -> Column:
    """URL11: ordered response rule; struct of ``is_pdf`` and the rule that fired (``method``)."""
    ct = F.lower(F.coalesce(col(content_type), F.lit("")))
    cd = F.lower(F.coalesce(col(disposition), F.lit("")))
    method = (F.when(F.lower(col(url)).endswith(".pdf"), "extension")
              .when(ct.contains("application/pdf"), "content_type")
              .when(cd.contains(".pdf") | cd.contains("application/pdf"), "content_disposition")
              .when(F.coalesce(col(embed), F.lit(False)), "embed")
              .when(is_pdf_url(url, rules), "url_rule")
              .when((col(status) == 200) & ct.contains("application/octet-stream") & (col(magic) == "PDF"), "magic")
              .otherwise("none"))
    return F.struct((method != "none").alias("is_pdf"), method.alias("method"))


def disposition_filename(header) -> Column:
    """URL12: suggested file name of a Content-Disposition header, NULL when there is none."""
    header = col(header)
    name = F.regexp_extract(header, r'(?i)filename\*?="?([^;"]+)"?', 1)
    return F.when(header.contains("filename=") & (name != ""), name)


def _drop_dots(p: Column) -> Column:
    segments = F.split(p, "/")
    folded = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))))
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(folded, str_array([""]))).otherwise(folded)
    joined = F.array_join(tail, "/")
    return F.when(p.rlike(r"(^|/)\.\.?(/|$)"),
                  F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))).otherwise(p)


def absolute_link(base, href) -> Column:
    """URL13: resolve a link against its base URL."""
    base, href = col(base), col(href)
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    base_path = F.when(path(base) == "", "/").otherwise(path(base))
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    href_path = F.regexp_extract(href, r"(?s)^([^?#]*)", 1)
    suffix = F.regexp_extract(href, r"(?s)^[^?#]*(.*)$", 1)
    base_query = F.when(query(base) == "", "").otherwise(F.concat(F.lit("?"), query(base)))
    return (F.when(href == "", base)
            .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
            .when(href.startswith("/"), F.concat(root, _drop_dots(href_path), suffix))
            .when(href.startswith("?"), F.concat(root, path(base), href))
            .when(href.startswith("#"), F.concat(root, path(base), base_query, href))
            .otherwise(F.concat(root, _drop_dots(F.concat(folder, href_path)), suffix)))


def cache_key(url, rules: Rules = DEFAULT_RULES) -> Column:
    """State key of a URL - ``host:template`` for a PDF file URL, else the host - and its decision."""
    host, template = norm_host(url), url_template(url)
    pdf = is_pdf_url(url, rules)
    key = F.when(pdf & (template != path(url)), F.concat(host, F.lit(":"), template)).otherwise(host)
    return F.struct(key.alias("cache_key"), F.when(pdf, F.lit("pdf")).alias("decision"))
