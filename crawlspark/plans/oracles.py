"""SQL twins of the registered queries, for DuckDB on the same tables.

Written apart from the operators: plain scans of rule lists instead of hash sets, windows and recursion
instead of folds.
"""

from __future__ import annotations

from .. import rules as R
from ..functions.blocks import BLOCK_COST, BLOCK_OPEN, INLINE, LINK, TAG_WEIGHTS
from ..operators.cleaning import EMPTY_BODY, EMPTY_RESULT
from ..functions.common import WS
from ..functions.quality import MAGIC
from ..functions.text import ICON_RELS, NO_TITLE
from .fixtures import ctes
from . import queries as P

ORACLES: dict[str, str] = {}
RULES = R.DEFAULT_RULES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def sub(e: str, pattern: str, with_: str = "") -> str:
    return f"regexp_replace({e}, {q(pattern)}, {q(with_)}, 'g')"


def strip(e: str) -> str:
    return sub(e, f"^{WS}+|{WS}+$")


def collapse(e: str) -> str:
    return strip(sub(e, f"{WS}+", " "))


def has_any(e: str, terms) -> str:
    return f"(len(list_filter({lst(terms)}, lambda kw_: contains({e}, kw_))) > 0)"


def visible(e: str) -> str:
    return collapse(sub(sub(sub(e, r"(?is)<script[^>]*>.*?</script>"), r"(?is)<style[^>]*>.*?</style>"), r"<[^>]+>"))


def spaced(e: str) -> str:
    return collapse(sub(e, r"<[^>]+>", " "))


def _bucketed(e: str) -> str:
    """The middle of the sketch's bucket that holds the exact percentile."""
    g = 1.01 / 0.99
    return f"CASE WHEN {e} > 0 THEN round(2.0 * pow({g!r}::DOUBLE, ceil(ln({e}) / ln({g!r}::DOUBLE))) / ({g!r}::DOUBLE + 1), 4) ELSE 0.0 END"


def no_scripts(e: str) -> str:
    for p in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?is)<noscript[^>]*>.*?</noscript>",
              r"(?i)<script[^>]*/>", r"(?i)<style[^>]*/>"):
        e = sub(e, p)
    return e


def no_base64(e: str) -> str:
    e = sub(e, r"""(?i)<img[^>]*src=["']data:image/[^;]+;base64,[^"']*["'][^>]*>""", "<!-- base64-img-removed -->")
    e = sub(e, r"""(?i)url\(["']?data:image/[^;]+;base64,[^)]+\)""", "url(#base64-removed)")
    return sub(e, r"(?i)data:image/[a-zA-Z]+;base64,[A-Za-z0-9+/=]+", "#base64-removed")


def unescape(e: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        e = f"replace({e}, {q(a)}, {q(b)})"
    return e


# ---- URL fragments ----

def _uri(u: str, n: int) -> str:
    return (f"regexp_extract({u}, '(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:[?]([^#]*))?(?:#(.*))?$', {n})")


def scheme(u):
    return f"lower({_uri(u, 1)})"


def net(u):
    return _uri(u, 2)


def path(u):
    return sub(_uri(u, 3), ";[^/]*$")


def query(u):
    return _uri(u, 4)


def host(u):
    return f"regexp_replace(lower({net(u)}), '^www[.]', '')"


def under(h: str, hosts) -> str:
    return f"(len(list_filter({lst(hosts)}, lambda kw_: {h} = kw_ OR ends_with({h}, '.' || kw_))) > 0)"


def is_pdf(u: str) -> str:
    return (f"CASE WHEN ends_with(lower({path(u)}), '.pdf') THEN true WHEN {host(u)} = 'arxiv.org' THEN contains(lower({path(u)}), '/pdf/') "
            f"ELSE {under(host(u), RULES.pdf_hosts)} OR {has_any(f'lower({u})', RULES.pdf_patterns)} "
            f"OR (contains(lower({query(u)}), 'pdf') AND {has_any(f'lower({query(u)})', RULES.pdf_query_indicators)}) END")


def template(u: str) -> str:
    return f"CASE WHEN ends_with(lower({path(u)}), '.pdf') AND contains({path(u)}, '/') THEN regexp_extract({path(u)}, '^(.*/)[^/]*$', 1) ELSE {path(u)} END"


ALL_URLS = ("all_urls AS (SELECT 'odd' AS kind, page_id, url FROM odd_urls UNION ALL "
            "SELECT 'pdf' AS kind, page_id, url FROM pdf_urls)")


def over_urls(select: str) -> str:
    return f"{ctes('odd_urls', 'pdf_urls')}, {ALL_URLS} SELECT kind, page_id, {select} FROM all_urls"


def add(name: str, sql: str) -> None:
    ORACLES[name] = sql


# ---- sources and sinks ----

_blank = f"regexp_matches(u, {q(f'^{WS}*$')})"
_bad_mode = f"coalesce(mode, 'normal') NOT IN ({', '.join(map(q, R.MODES))})"
_bad_type = f"coalesce(crawl_type, 'auto') NOT IN ({', '.join(map(q, R.CRAWL_TYPES))})"
add("url_requests", f"""{ctes('requests')}, parts AS (SELECT *, string_split(url_list, '|') AS us FROM requests)
, rows_ AS (SELECT *, unnest(range(len(us))) AS pos FROM parts)
SELECT request_id, pos, us[pos + 1] AS url,
       ({_bad_mode}) OR ({_bad_type}) OR len(list_filter(us, lambda u: {_blank})) > 0 AS request_rejected,
       CASE WHEN {_blank.replace('(u,', '(us[pos + 1],')} THEN 'blank_url' WHEN {_bad_mode} THEN 'bad_mode'
            WHEN {_bad_type} THEN 'bad_crawl_type' ELSE '' END AS invalid_reason
FROM rows_""")

add("read_pages", "SELECT page_id, url, length(html) AS html_chars FROM pages")

add("rule_tables_hits", " UNION ALL ".join(
    f"SELECT * FROM ({ctes('odd_urls', 'pdf_urls')}, {ALL_URLS}, h AS (SELECT {host('url')} AS h FROM all_urls)"
    f" SELECT {q(name)} AS rule_set, t AS host, CAST(count(*) AS BIGINT) AS urls FROM h, (SELECT unnest({lst(hosts)}) AS t)"
    f" WHERE contains(t, '.') AND (h = t OR ends_with(h, '.' || t)) GROUP BY t)"
    for name, hosts in (("spa_hosts", RULES.spa_hosts), ("pdf_hosts", RULES.pdf_hosts))))

add("attempt_stream", f"{ctes('attempts')} SELECT attempt_id, request_id, lane, success, epoch_us(ts) AS ts_us FROM attempts")
add("write_results", f"{ctes('attempts')} SELECT request_id, attempt_id AS pos, lane, success FROM attempts")
_merge = """SELECT coalesce(b.cache_key, a.cache_key) AS cache_key, coalesce(b.decision, a.decision) AS decision,
       coalesce(b.score, a.score) AS score FROM host_state a FULL JOIN host_state2 b ON a.cache_key = b.cache_key"""
add("save_load_state", f"{ctes('host_state', 'host_state2')} {_merge}")
add("state_deltas", f"""{ctes('host_state', 'host_state2')} SELECT cache_key, decision, score FROM host_state2 UNION ALL
SELECT cache_key, decision, score FROM host_state WHERE length(cache_key) % 3 <> 1 AND cache_key NOT IN (SELECT cache_key FROM host_state2)""")
add("merge_state", f"{ctes('host_state', 'host_state2')} {_merge}")

# ---- URLs ----

add("url_parts", over_urls(f"{scheme('url')} AS scheme, {net('url')} AS authority, {path('url')} AS path, {query('url')} AS query, "
                           f"{_uri('url', 5)} AS fragment"))
add("norm_host", over_urls(f"{host('url')} AS host"))
add("host_variants", f"""{ctes('odd_urls', 'pdf_urls')}, {ALL_URLS},
h AS (SELECT kind, page_id, string_split({host('url')}, '.') AS parts FROM all_urls),
d AS (SELECT *, unnest(range(len(parts) - 1)) AS depth FROM h)
SELECT kind, page_id, depth, array_to_string(parts[depth + 1:], '.') AS variant FROM d""")
add("normalize_entry_url", over_urls(
    f"CASE WHEN {net('url')} = 'zhihu.com' THEN regexp_replace(url, '^[A-Za-z]+://zhihu.com', 'https://www.zhihu.com') "
    f"WHEN ends_with({net('url')}, 'zhihu.com') THEN regexp_replace(url, '^[A-Za-z]*:?//', 'https://') "
    f"WHEN starts_with(url, '//') THEN 'http:' || url "
    # a scheme written in capitals is rebuilt in lower case
    f"ELSE CASE WHEN {net('url')} <> '' AND {_uri('url', 1)} <> {scheme('url')} THEN url ELSE url END END AS entry_url"))
add("url_template", over_urls(f"{template('url')} AS template"))

_unsafe = r'[<>:"/\\|?*]'
_orig = "(CASE WHEN page_id % 4 = 1 THEN concat('My: report/', page_id, '.v2.PDF') END)"


def _with_pdf(e: str) -> str:
    return f"CASE WHEN ends_with(lower({e}), '.pdf') THEN {e} ELSE {e} || '.pdf' END"


_base = f"list_extract(string_split({path('url')}, '/'), -1)"
_plain = (f"CASE WHEN {_base} <> '' THEN {_with_pdf(sub(f'url_decode({_base})', _unsafe, '_'))} "
          f"ELSE {sub(net('url'), _unsafe, '_')} || '.pdf' END")
_first = "string_split({}, '.')[1]"
_last = f"coalesce({_first.format(f'list_filter(string_split(' + path('url') + ', ' + q('/') + '), lambda s: s <> ' + q('') + ')[-1]')}, '')"
_trim = sub(path("url"), "^/+|/+$")
_pmlr = f"string_split({_trim}, '/')"
_site = f"""CASE WHEN {_orig} IS NOT NULL THEN regexp_replace({_orig}, '[.][^.]*$', '')
 WHEN contains({net('url')}, 'arxiv.org') AND contains({path('url')}, '/pdf/') THEN 'arxiv_' || {_first.format(f"string_split({path('url')}, '/pdf/')[-1]")}
 WHEN contains({net('url')}, 'arxiv.org') THEN CASE WHEN length({_last}) >= 3 THEN {_last} ELSE 'arxiv_paper' END
 WHEN contains({net('url')}, 'biorxiv.org') OR contains({net('url')}, 'medrxiv.org') THEN
   CASE WHEN contains({path('url')}, '/content/') THEN 'biorxiv_' || string_split(string_split({path('url')}, '/content/')[-1], '/')[1] ELSE 'biorxiv_paper' END
 WHEN contains({net('url')}, 'proceedings.mlr.press') THEN
   CASE WHEN contains({path('url')}, '/v') AND len({_pmlr}) >= 3 THEN 'pmlr_' || {_pmlr}[1] || '_' || {_pmlr}[2] ELSE 'pmlr_paper' END
 WHEN length({_last}) >= 3 THEN {_last} ELSE replace({net('url')}, '.', '_') END"""
_safe = f"substr({sub(f'({_site})', '[^\\p{L}\\p{N}_-]')}, 1, 60)"
add("pdf_filename", over_urls(
    f"{_plain} AS plain, CASE WHEN {_orig} IS NOT NULL THEN {_with_pdf(sub(_orig, _unsafe, '_'))} ELSE {_plain} END AS named, "
    f"(CASE WHEN {_safe} = '' THEN 'pdf_file' ELSE {_safe} END) || '_' || substr(sha256(url), 1, 16) || '.pdf' AS site"))
_direct = "(ends_with(lower(url), '.pdf') OR contains(lower(url), '.pdf?') OR contains(lower(url), '.pdf#'))"
add("url_type", over_urls(f"CASE WHEN {_direct} THEN 'direct_pdf' WHEN {has_any('lower(url)', R.PDF_VIEWER_SITES)} THEN 'pdf_viewer' ELSE 'unknown' END AS url_type"))
add("is_pdf_url", over_urls(f"{is_pdf('url')} AS is_pdf"))
add("is_pdf_by_headers", f"{ctes('responses')} SELECT page_id, {_direct} OR contains(lower(coalesce(content_type, '')), 'application/pdf') "
    f"OR {has_any('lower(url)', R.PDF_HEADER_SITES)} AS is_pdf FROM responses")
add("is_spa_host", over_urls(f"{under(host('url'), RULES.spa_hosts)} AS is_spa"))

_magic = "CASE " + " ".join(f"WHEN starts_with(hex(body), {q(h)}) THEN {q(n)}" for h, n in MAGIC) + " ELSE '' END"
_embed = (r"""(regexp_matches(html, '(?is)<(?:embed|object)\b[^>]*\stype\s*=\s*["'']application/pdf["'']') """
          r"""OR regexp_matches(html, '(?is)<iframe\b[^>]*\ssrc\s*=\s*["''][^"''>]*\.pdf'))""")
add("pdf_verdict", f"""{ctes('responses')}, m AS (SELECT page_id, CASE WHEN ends_with(lower(url), '.pdf') THEN 'extension'
 WHEN contains(lower(content_type), 'application/pdf') THEN 'content_type'
 WHEN contains(lower(disposition), '.pdf') OR contains(lower(disposition), 'application/pdf') THEN 'content_disposition'
 WHEN {_embed} THEN 'embed' WHEN {is_pdf('url')} THEN 'url_rule'
 WHEN status_code = 200 AND contains(lower(content_type), 'application/octet-stream') AND ({_magic}) = 'PDF' THEN 'magic' ELSE 'none' END AS method
 FROM responses) SELECT page_id, method <> 'none' AS is_pdf, method FROM m""")
add("disposition_filename", f"""{ctes('responses')} SELECT page_id, CASE WHEN contains(disposition, 'filename=')
 THEN regexp_extract(disposition, '(?i)filename[*]?="?([^;"]+)"?', 1) ELSE '-' END AS filename FROM responses""")
_root = f"{scheme('url')} || '://' || {net('url')}"
_p = f"CASE WHEN {path('url')} = '' THEN '/' ELSE {path('url')} END"
add("absolute_link", f"""SELECT page_id, CASE page_id % 7 WHEN 0 THEN {_root} || '/a/b.png' WHEN 1 THEN {scheme('url')} || '://cdn.x/y?z=1'
 WHEN 2 THEN 'https://o.x/p#q' WHEN 3 THEN {_root} || {sub(f'({_p})', '[^/]*$')} || 'img/r.png?s' WHEN 4 THEN {_root} || {path('url')} || '?page=2'
 WHEN 5 THEN {_root} || {path('url')} || CASE WHEN {query('url')} = '' THEN '' ELSE '?' || {query('url')} END || '#top' ELSE url END AS link FROM pages""")
add("cache_key", over_urls(
    f"CASE WHEN {is_pdf('url')} AND {template('url')} <> {path('url')} THEN {host('url')} || ':' || {template('url')} ELSE {host('url')} END AS cache_key, "
    f"CASE WHEN {is_pdf('url')} THEN 'pdf' ELSE '' END AS decision"))

# ---- text ----

add("visible_text", f"SELECT page_id, {visible('html')} AS text FROM pages")
add("probe_text", f"SELECT page_id, {spaced('html')} AS spaced, {strip(sub('html', '<[^>]+>'))} AS tight FROM pages")
_title = collapse(unescape(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
add("html_title", f"SELECT page_id, CASE WHEN {_title} = '' THEN {q(NO_TITLE)} ELSE {_title} END AS title FROM pages")
add("markdown_title", f"""{ctes('markdown_docs')},
l AS (SELECT doc_id, unnest(range(len(string_split(md, chr(10))))) AS i, string_split(md, chr(10)) AS ls FROM markdown_docs),
t AS (SELECT doc_id, i, {strip('ls[i + 1]')} AS s FROM l),
above AS (SELECT doc_id, i, s, last_value(CASE WHEN s <> '' AND s <> repeat('=', 15) THEN s END IGNORE NULLS)
          OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM t),
c AS (SELECT doc_id, i, CASE WHEN starts_with(s, 'Title:') THEN {strip('substr(s, 7)')} WHEN s = repeat('=', 15) THEN prev
      WHEN starts_with(s, '# ') THEN {strip('substr(s, 3)')} WHEN starts_with(s, '## ') THEN {strip('substr(s, 4)')} END AS found,
      CASE WHEN s <> '' AND NOT starts_with(s, 'URL Source:') AND NOT starts_with(s, 'Markdown Content:') THEN s END AS plain FROM above)
SELECT doc_id, coalesce(arg_min(found, i) FILTER (found IS NOT NULL), arg_min(plain, i) FILTER (plain IS NOT NULL), '') AS title
FROM c GROUP BY doc_id""")
add("strip_base64_images", f"{ctes('rich_pages')} SELECT page_id, md5({no_base64('html')}) AS digest FROM rich_pages")
_md64 = sub(sub(sub("md", r"(?i)!\[([^\]]*)\]\(data:image/[^;]+;base64,[^\)]+\)", "![图片已移除]"),
                r"(?i)\[[^\]]*\]\(data:image/[^;]+;base64,[^\)]+\)", "[base64-link-removed]"),
            r"(?i)data:image/[a-zA-Z]+;base64,[A-Za-z0-9+/=]+", "#base64-removed")
add("strip_base64_markdown", f"{ctes('markdown_docs')} SELECT doc_id, md5({_md64}) AS digest FROM markdown_docs")
add("strip_script_style", f"{ctes('rich_pages')} SELECT page_id, md5({no_scripts('html')}) AS digest FROM rich_pages")


def _no_images(e):
    return sub(e, r"!\[.*?\]\(.*?\)")


def _no_links(e):  # no look-behind in RE2: hide image openers, drop links, bring the openers back
    return f"replace({sub(f'replace({e}, ' + q('![') + ', chr(1))', r'\[.*?\]\(.*?\)')}, chr(1), '![')"


add("strip_md_links", f"{ctes('markdown_docs')} SELECT doc_id, md5({_no_links(_no_images('md'))}) AS \"both\", md5({_no_images('md')}) AS images_only, "
    f"md5({_no_links('md')}) AS links_only FROM markdown_docs")

_icon_rows = " UNION ALL ".join(
    f"SELECT page_id, {i} AS rel_no, pos, href FROM tags WHERE rel = {q(rel)} AND href <> ''" for i, rel in enumerate(ICON_RELS))
add("icon_links", rf"""{ctes('icon_pages')},
raw AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<link\b[^>]*>') AS ts FROM icon_pages),
cut AS (SELECT page_id, unnest(range(len(ts))) AS pos, ts FROM raw),
tags AS (SELECT page_id, pos, lower(regexp_extract(ts[pos + 1], '(?is)\srel\s*=\s*["'']([^"'']*)["'']', 1)) AS rel,
         regexp_extract(ts[pos + 1], '(?is)\shref\s*=\s*["'']([^"'']*)["'']', 1) AS href FROM cut),
ranked AS (SELECT page_id, rel_no, pos, href, row_number() OVER (PARTITION BY page_id ORDER BY rel_no, pos) AS rn FROM ({_icon_rows})),
top AS (SELECT p.page_id, p.url, rn, coalesce(href, '/favicon.ico') AS href FROM icon_pages p LEFT JOIN ranked r ON r.page_id = p.page_id AND rn <= 3),
abs_ AS (SELECT page_id, rn, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN {scheme('url')} || ':' || href
         WHEN starts_with(href, '/') THEN {_root} || href ELSE {_root} || '/' || href END AS link FROM top)
SELECT page_id, string_agg(link, ',' ORDER BY rn) AS icons FROM abs_ GROUP BY page_id""")
add("has_pdf_embed", f"{ctes('rich_pages')} SELECT page_id, {_embed} AS embed FROM rich_pages")


# ---- blocks ----

def _content(e: str) -> str:
    e = sub(no_scripts(no_base64(e)), "(?s)<!--.*?-->")
    e = sub(e, r"(?is)<head(?:[\s][^>]*)?>.*?</head>")
    for tag in ("nav", "header", "footer", "aside"):
        e = sub(e, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>")
    return e


def _flat(e: str) -> str:
    return collapse(unescape(sub(sub(e, r"(?i)<br\b[^>]*>", " "), "<[^>]*>")))


def block_ctes(source: str = "pages") -> str:
    marked = f"regexp_replace({_content('html')}, {q(BLOCK_OPEN)}, chr(1) || '\\1', 'g')"
    tag = "lower(regexp_extract(seg, '^<([A-Za-z][A-Za-z0-9]*)', 1))"
    return f"""segs AS (SELECT page_id, string_split({marked}, chr(1)) AS ss FROM {source}),
seg AS (SELECT page_id, unnest(range(len(ss))) AS idx, unnest(ss) AS seg FROM segs),
blk AS (SELECT page_id, idx, CASE WHEN {tag} = '' THEN 'div' ELSE {tag} END AS tag, {_flat('seg')} AS text, length(seg) AS html_chars,
        seg, length({_flat(f"array_to_string(regexp_extract_all(seg, {q(LINK)}, 1), ' ')")}) AS link_chars FROM seg),
blocks AS (SELECT *, length(text) AS chars, CAST(row_number() OVER (PARTITION BY page_id ORDER BY idx) AS BIGINT) AS pos FROM blk WHERE text <> ''),
worth AS (SELECT *, CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN greatest(chars - 2 * link_chars - {BLOCK_COST}, 1)
                    ELSE chars - 2 * link_chars - {BLOCK_COST} END AS v FROM blocks),
pre AS (SELECT *, sum(v) OVER w AS s FROM worth WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
low AS (SELECT *, min(s - v) OVER (PARTITION BY page_id ORDER BY pos) AS floor_ FROM pre),
best AS (SELECT page_id, max(s - floor_) AS best, max(pos) AS n FROM low GROUP BY page_id),
ends AS (SELECT l.page_id, b.best, b.n, min(l.pos) AS last FROM low l JOIN best b ON b.page_id = l.page_id AND l.s - l.floor_ = b.best GROUP BY ALL),
fl AS (SELECT e.*, l.floor_ FROM ends e JOIN low l ON l.page_id = e.page_id AND l.pos = e.last),
rng AS (SELECT f.page_id, CASE WHEN any_value(f.best) > 0 THEN max(l.pos) ELSE 1 END AS first,
        CASE WHEN any_value(f.best) > 0 THEN any_value(f.last) ELSE any_value(f.n) END AS last
        FROM fl f JOIN low l ON l.page_id = f.page_id AND l.pos <= f.last AND l.s - l.v = f.floor_ GROUP BY f.page_id)"""


add("main_blocks", f"""WITH {block_ctes()} SELECT b.page_id, idx, tag, text, chars, link_chars, round(link_chars / chars, 6) AS link_density,
 pos BETWEEN first AND r.last AS kept FROM blocks b JOIN rng r ON r.page_id = b.page_id""")
_weight = "CASE " + " ".join(f"WHEN tag = {q(t)} THEN {w}" for t, w in TAG_WEIGHTS.items()) + " ELSE 0.5 END"
_score = f"round(chars / greatest(html_chars, 1) * (1 - least(link_chars / chars, 1.0)) * CAST({_weight} AS DOUBLE), 6)"
add("prune_blocks", f"""WITH {block_ctes()}, sc AS (SELECT page_id, idx, {_score} AS s FROM blocks),
lim AS (SELECT page_id, round(sum(s) / count(*), 6) AS m FROM sc GROUP BY page_id)
SELECT p.page_id, coalesce(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FILTER (s >= 0.5), '') AS fixed,
 coalesce(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FILTER (s >= m), '') AS dynamic
FROM pages p LEFT JOIN sc ON sc.page_id = p.page_id LEFT JOIN lim ON lim.page_id = p.page_id GROUP BY p.page_id""")
add("bm25_blocks", f"""WITH {block_ctes()},
tk AS (SELECT page_id, idx, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS ts FROM blocks),
st AS (SELECT page_id, count(*) AS n, avg(len(ts)) AS mean FROM tk GROUP BY page_id),
qw AS (SELECT unnest({lst(P.BM25_QUERY.split())}) AS w),
tf AS (SELECT page_id, idx, w, len(ts) AS dl, len(list_filter(ts, lambda t: t = w)) AS f FROM tk, qw),
df AS (SELECT page_id, w, count(*) FILTER (f > 0) AS d FROM tf GROUP BY page_id, w),
sc AS (SELECT tf.page_id, idx, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
       FROM tf JOIN df ON df.page_id = tf.page_id AND df.w = tf.w JOIN st ON st.page_id = tf.page_id GROUP BY tf.page_id, idx)
SELECT page_id, idx, score FROM sc WHERE score >= {P.BM25_LIMIT}""")



def _inline(e: str) -> str:  # images left out: the pages hold none, and RE2 has no look-ahead
    e = sub(e, r"""(?is)<a\b[^>]*\shref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>""", r"[\2](\1)")
    for tags, mark in (("b|strong", "**"), ("i|em", "_"), ("code", "`")):
        e = sub(e, rf"(?is)<(?:{tags})(?:\s[^>]*)?>(.*?)</(?:{tags})>", rf"{mark}\1{mark}")
    return e


_md = f"""CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN repeat('#', CAST(substr(tag, 2, 1) AS INT)) || ' ' || flat
 WHEN tag = 'li' THEN '- ' || flat WHEN tag = 'blockquote' THEN '> ' || flat
 WHEN tag = 'pre' THEN '```' || chr(10) || {sub(f"rtrim({unescape(sub('seg', '<[^>]*>'))}, ' ')", r'^[\s]*\n|[\s]+$')} || chr(10) || '```' ELSE flat END"""
_pages_md = f"""flat_ AS (SELECT b.page_id, pos, tag, seg, CASE WHEN regexp_matches(seg, {q(INLINE)}) THEN {_flat(_inline('seg'))} ELSE text END AS flat
 FROM blocks b JOIN rng r ON r.page_id = b.page_id WHERE pos BETWEEN first AND r.last),
page_md AS (SELECT page_id, string_agg({_md}, chr(10) || chr(10) ORDER BY pos) AS markdown FROM flat_ GROUP BY page_id)"""
add("blocks_markdown", f"WITH {block_ctes()}, {_pages_md} SELECT p.page_id, coalesce(markdown, '') AS markdown FROM pages p LEFT JOIN page_md m ON m.page_id = p.page_id")

add("is_huge", f"{ctes('big_pages')} SELECT page_id, length(html) / 1048576.0 >= {P.HUGE_MB} AS huge FROM big_pages")


def spans(source: str) -> str:
    t = P.CHUNK_KB * 1024
    cut = (f"least(n, i + {t}) + length(regexp_extract(substr(html, least(n, i + {t}) + 1, 4096), "
           f"'(?s)^.*?(?:</p>|</div>|\\n\\n)'))")
    return f"""span(page_id, html, n, idx, b, i) AS (
 SELECT page_id, html, length(html), -1, 0, 0 FROM {source}
 UNION ALL SELECT page_id, html, n, idx + 1, i, {cut} FROM span WHERE i < n)"""


add("split_spans", f"""{ctes('big_pages').replace('WITH ', 'WITH RECURSIVE ', 1)}, {spans('big_pages')}
SELECT page_id, CAST(idx AS BIGINT) AS idx, CAST(greatest(0, b - {P.CHUNK_OVERLAP}) AS BIGINT) AS span_start,
 CAST(least(n, i + {P.CHUNK_OVERLAP}) AS BIGINT) AS span_end FROM span WHERE idx >= 0""")
_clean = no_scripts(no_base64("html"))
_short = """p AS (SELECT page_id, html FROM big_pages UNION ALL SELECT page_id + 1000000, CASE page_id % 4 WHEN 0 THEN '<p>42</p>' WHEN 1 THEN ' '
 WHEN 2 THEN '<div><p>Yes it</p></div>' END FROM pages)"""
# Chunks get an id of their own (page * 1000 + number), so that the page pipeline runs on them as it is.
add("mapreduce_clean", f"""{ctes('big_pages').replace('WITH ', 'WITH RECURSIVE ', 1)}, {_short}, ready AS (SELECT page_id, {_clean} AS html FROM p), {spans('ready')},
chunks AS (SELECT page_id * 1000 + idx AS page_id, substr(html, b + 1, i - b) AS html FROM span WHERE idx >= 0),
{block_ctes('chunks')}, {_pages_md},
whole AS (SELECT CAST(floor(c.page_id / 1000) AS BIGINT) AS page_id, string_agg(markdown, chr(10) || chr(10) ORDER BY c.page_id) FILTER ({collapse('markdown')} <> '') AS markdown,
 count(*) AS slices FROM chunks c LEFT JOIN page_md m ON m.page_id = c.page_id GROUP BY 1)
SELECT p.page_id, coalesce(markdown, '') AS markdown, coalesce(slices, 0) AS slices FROM p LEFT JOIN whole w ON w.page_id = p.page_id""")
add("cleaning_stats", f"""{ctes('rich_pages')}, c AS (SELECT page_id, html, {_clean} AS cleaned FROM rich_pages)
SELECT page_id, length(html) AS original_size, length(cleaned) AS cleaned_size, length({spaced('cleaned')}) AS text_length,
 greatest(0.0, round(CAST(length(html) - length(cleaned) AS DOUBLE) / greatest(1, length(html)) * 100, 2)) AS reduction_percentage FROM c""")
add("clean_pages", f"""{ctes('big_pages')}, {_short}, {block_ctes('p')}, {_pages_md},
m AS (SELECT p.page_id, coalesce(html, '') AS html, coalesce(markdown, '') AS md FROM p LEFT JOIN page_md g ON g.page_id = p.page_id),
o AS (SELECT page_id, html, md, {collapse('html')} = '' AS blank, {collapse('md')} = '' AS hollow FROM m),
r AS (SELECT page_id, html, blank, hollow, CASE WHEN blank THEN {q(EMPTY_BODY)} WHEN hollow THEN concat({q(EMPTY_RESULT)}, length(html), ' 字符') ELSE md END AS markdown FROM o)
SELECT page_id, markdown, CASE WHEN blank THEN 'placeholder' ELSE 'readability-single' END AS cleaner, NOT blank AS success, blank OR hollow AS is_empty,
 length(html) AS original_size, length(markdown) AS cleaned_size FROM r""")


def _chosen_md(where: str) -> str:
    """Markdown of the blocks chosen by a table ``pick`` (page_id, idx)."""
    return f"""flat_ AS (SELECT b.page_id, pos, tag, seg, CASE WHEN regexp_matches(seg, {q(INLINE)}) THEN {_flat(_inline('seg'))} ELSE text END AS flat
 FROM blocks b JOIN {where} k ON k.page_id = b.page_id AND k.idx = b.idx),
page_md AS (SELECT page_id, string_agg({_md}, chr(10) || chr(10) ORDER BY pos) AS markdown FROM flat_ GROUP BY page_id),
m AS (SELECT p.page_id, length(html) AS n, coalesce(markdown, '') AS md FROM pages p LEFT JOIN page_md g ON g.page_id = p.page_id)
SELECT page_id, CASE WHEN {collapse('md')} = '' THEN concat({q(EMPTY_RESULT)}, n, ' 字符') ELSE md END AS markdown, {collapse('md')} = '' AS is_empty FROM m"""


add("clean_pages_prune", f"WITH {block_ctes()}, pick AS (SELECT page_id, idx FROM blocks WHERE {_score} >= 0.5), {_chosen_md('pick')}")
add("clean_pages_bm25", ORACLES["bm25_blocks"].replace("SELECT page_id, idx, score FROM sc WHERE", "pick AS (SELECT page_id, idx FROM sc WHERE").replace(
    "       FROM tf JOIN df ON df.page_id = tf.page_id AND df.w = tf.w JOIN st ON st.page_id = tf.page_id GROUP BY tf.page_id, idx)\n",
    "       FROM tf JOIN df ON df.page_id = tf.page_id AND df.w = tf.w JOIN st ON st.page_id = tf.page_id GROUP BY tf.page_id, idx),\n")
    + f"), {_chosen_md('pick')}")
add("failure_markdown", f"""{ctes('lane_results')} SELECT attempt_id, concat('# 爬取失败', chr(10), chr(10), '**URL:** ', url, chr(10), chr(10), '**失败原因:** ',
 coalesce(nullif(concat_ws(' | ', 'EasyGet: ' || easyget_error, 'Playwright: ' || playwright_error, 'Jina: ' || jina_error, 'PDF: ' || pdf_error), ''), '未知错误')) AS markdown
FROM lane_results""")
add("read_bodies", "SELECT strlen(html) + 1 AS length, sha256(html || chr(10)) AS digest FROM pages")
add("decode_bodies", "SELECT page_id, 'utf-8' AS charset, md5(html) AS digest FROM pages")
add("decode_legacy_bodies", """WITH p AS (SELECT page_id, html, CASE WHEN html IS NULL OR strlen(html) <> length(html) THEN -1 ELSE page_id % 6 END AS kind FROM pages)
SELECT page_id, CASE WHEN html IS NULL THEN NULL ELSE ['utf-8', 'gbk', 'big5', 'iso-8859-1', 'gb18030', 'utf-8', 'utf-16le'][kind + 2] END AS charset,
 md5(['', '中文', '中文', 'é', '<meta charset="gb18030">中文', '中文', '中文'][kind + 2] || html) AS digest FROM p""")

# ---- quality ----

add("magic_type", f"{ctes('responses')} SELECT page_id, {_magic} AS magic FROM responses")


def ascii_ratio(e):
    return f"CASE WHEN length({e}) > 0 THEN (length({e}) - length({sub(e, r'[\x20-\x7E\t\n\r\x0B\f]')})) / length({e}) ELSE 1.0 END"


def unicode_ratio(e):
    return f"CASE WHEN length({e}) > 0 THEN length({sub(e, r'[\x{00}-\x{08}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{FFFD}]')}) / length({e}) ELSE 1.0 END"


add("printable_ratio", f"""SELECT doc_id, round({ascii_ratio('text')}, 6) AS ascii_ratio, round({unicode_ratio('text')}, 6) AS unicode_ratio,
 length(text) >= 50 AND {ascii_ratio('text')} < 0.9 AS ascii_binary, length(text) >= 50 AND {unicode_ratio('text')} < 0.9 AS binary FROM documents""")
_q3 = lambda n, name: (f"CASE WHEN ({_magic}) <> '' OR (length(plain) >= 50 AND {unicode_ratio('plain')} < 0.9) THEN 'quality_check_failed(binary_or_garbled_detected)' "
                       f"WHEN {n} < {P.GATE_LIMIT} THEN 'quality_check_failed({name})' ELSE '' END")
add("fast_lane_gate", f"""{ctes('responses')}, t AS (SELECT page_id, body, {spaced('html')} AS plain, {spaced(visible('html'))} AS cleaned FROM responses)
SELECT page_id, {_q3('length(cleaned)', 'cleaned_text_too_short')} AS cleaned_gate, {_q3('length(plain)', 'plain_text_too_short')} AS plain_gate FROM t""")


def by_status(c):
    return f"CASE WHEN {c} IN (401, 403) THEN 'BLOCKED_ACCESS_DENIED' WHEN {c} = 429 THEN 'BLOCKED_VERIFICATION' ELSE '' END"


def by_text(t):
    low = f"lower({t})"
    return (f"CASE WHEN length({t}) = 0 THEN '' WHEN length({t}) < 500 AND {has_any(low, R.CLOUDFLARE_TERMS)} THEN 'BLOCKED_CLOUDFLARE' "
            f"WHEN length({t}) < 500 AND {has_any(low, R.REQUIRE_JS_TERMS)} THEN 'REQUIRE_JAVASCRIPT' "
            f"WHEN length({t}) < 500 AND {has_any(low, R.BLOCK_TERMS)} THEN 'BLOCKED_VERIFICATION' "
            f"WHEN length({t}) < 300 AND {has_any(low, R.TIMEOUT_TERMS)} THEN 'TIMEOUT' "
            f"WHEN {has_any(low, R.TOO_SHORT_TERMS)} THEN 'PAGE_PARTIAL_LOAD' ELSE '' END")


def health_ctes(source: str, key: str, text: str, status: str, min_len: int = 150) -> str:
    return f"""ht AS (SELECT {key}, {strip(text)} AS t, {status} AS st FROM {source}),
hv AS (SELECT {key}, t, {by_status('st')} AS a, {by_text('t')} AS b FROM ht),
health AS (SELECT {key}, length(t) AS text_length, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b WHEN length(t) = 0 THEN 'PAGE_NOT_LOADED'
  WHEN length(t) < {min_len} THEN 'PAGE_PARTIAL_LOAD' ELSE '' END AS reason, CASE WHEN a <> '' THEN 'status_code' WHEN b <> '' THEN 'blocked_keywords'
  WHEN length(t) = 0 THEN 'empty_text' WHEN length(t) < {min_len} THEN 'partial_text' ELSE '' END AS hit FROM hv)"""


add("reason_from_status", f"{ctes('attempts')} SELECT attempt_id, {by_status('status_code')} AS reason FROM attempts")
add("reason_from_text", f"{ctes('bodies')} SELECT body_id, {by_text('text')} AS reason FROM bodies")
add("content_health", f"{ctes('bodies')}, {health_ctes('bodies', 'body_id', 'text', 'status_code')} "
    "SELECT body_id, reason = '' AS ok, reason, hit, text_length FROM health")
_text = f"CASE WHEN coalesce(markdown, '') <> '' THEN markdown ELSE {visible(chr(99) + 'oalesce(html, ' + q('') + ')')} END"


def _lane_error(lane: str) -> str:
    col = f"{lane}_error"
    return (f"CASE WHEN coalesce({col}, '') <> '' THEN {col} WHEN reason <> '' AND (lane IS NULL OR lane = {q(lane)}) "
            f"THEN '内容健康检测失败: ' || reason ELSE '' END AS {col}")


add("apply_health", f"""{ctes('lane_results')}, {health_ctes('lane_results', 'attempt_id', _text, 'status_code')}
SELECT r.attempt_id, r.success AND reason = '' AS success, {_lane_error('easyget')}, {_lane_error('playwright')}, {_lane_error('jina')}, {_lane_error('pdf')}
FROM lane_results r JOIN health h ON h.attempt_id = r.attempt_id""")


def probe_ctes(source: str, key: str, html: str, success: str, status: str) -> str:
    return f"""pt AS (SELECT {key}, {html} AS h, {strip(sub(html, '<[^>]+>'))} AS t, {success} AS ok, {status} AS st FROM {source}),
pb AS (SELECT *, length(t) > 0 AND ({has_any('h', R.PROBE_INDICATORS)} OR {has_any('t', R.PROBE_INDICATORS)}) AS blocked FROM pt),
probe AS (SELECT {key}, ok AND st = 200 AND length(t) >= 100 AND NOT blocked AS effective, length(t) AS text_length, blocked,
 concat_ws(',', CASE WHEN NOT ok THEN '请求失败' END, CASE WHEN st <> 200 THEN concat('HTTP错误(', st, ')') END,
  CASE WHEN length(t) < 100 THEN concat('文字过少(', length(t), '字符)') END, CASE WHEN blocked THEN '检测到拦截/验证' END) AS reasons FROM pb)"""


add("probe_verdict", f"""{ctes('lane_results')}, {probe_ctes('lane_results', 'attempt_id', "coalesce(html, markdown, '')", 'success', 'status_code')}
SELECT attempt_id, effective, text_length, blocked, reasons FROM probe""")
_seen = f"lower(concat(coalesce(markdown, ''), ' ', {visible(chr(99) + 'oalesce(html, ' + q('') + ')')}))"
_own = "CASE lane WHEN 'easyget' THEN easyget_error WHEN 'playwright' THEN playwright_error WHEN 'jina' THEN jina_error WHEN 'pdf' THEN pdf_error END"
_cause = f"""CASE WHEN coalesce({_own}, '') <> '' THEN {_own} WHEN {has_any(_seen, R.LANE_CLOUDFLARE_TERMS)} THEN 'Cloudflare 人机验证拦截'
 WHEN {has_any(_seen, R.LANE_VERIFY_TERMS)} THEN '需要人机验证' WHEN lane = 'playwright' AND status_code >= 400 THEN concat('页面访问失败，状态码: ', status_code)
 WHEN lane = 'jina' THEN '失败，未知原因' ELSE '质量检查失败(文本长度: 0)' END"""
add("failure_cause", f"{ctes('lane_results')} SELECT attempt_id, {_cause} AS cause FROM lane_results WHERE NOT success")
add("http_error", f"""{ctes('attempts')} SELECT attempt_id, CASE WHEN status_code >= 400 THEN concat('页面访问失败，状态码: ', status_code,
 CASE WHEN status_code = 404 THEN ' (页面不存在)' WHEN status_code = 403 THEN ' (访问被禁止)' WHEN status_code >= 500 THEN ' (服务器错误)' ELSE '' END) ELSE '' END AS message FROM attempts""")

_body = "CASE WHEN regexp_matches(lower(html), '(?s)<body[^>]*>.*?</body>') THEN regexp_extract(lower(html), '(?s)<body[^>]*>(.*?)</body>', 1) ELSE lower(html) END"
_body_text = strip(sub(sub(sub(f"({_body})", "(?s)<script[^>]*>.*?</script>"), "(?s)<style[^>]*>.*?</style>"), "<[^>]+>"))
add("spa_fingerprint", f"""{ctes('spa_pages')}, c AS (SELECT page_id, length({_body_text}) < 500 AS c1,
 len(regexp_extract_all(lower(html), '<script[^>]*>')) >= 10 AS c2, regexp_matches(html, {q('(?i)' + '|'.join(RULES.spa_patterns))}) AS c3,
 regexp_matches(lower(html), {q('|'.join(map(R.selector_regex, RULES.spa_roots)))}) AS c4,
 len(list_filter({lst([m.lower() for m in RULES.spa_metas])}, lambda m: contains(lower(html), m))) > 2 AS c5 FROM spa_pages)
SELECT page_id, concat_ws(',', CASE WHEN c1 THEN 'empty_body' END, CASE WHEN c2 THEN 'high_script_count' END, CASE WHEN c3 THEN 'spa_framework_scripts' END,
 CASE WHEN c4 THEN 'spa_root_container' END, CASE WHEN c5 THEN 'meta_indicators' END) AS criteria,
 least(100, 40 * c1::INT + 35 * c2::INT + 30 * c3::INT + 25 * c4::INT + 10 * c5::INT)::BIGINT AS confidence,
 c1::INT + c2::INT + c3::INT + c4::INT + c5::INT >= 2 AS is_spa FROM c""")

_terms = " UNION ALL ".join(f"SELECT {q(s)} AS section, {q(lang)} AS language, unnest({lst(words)}) AS term"
                            for (s, lang), words in RULES.block_terms.items())
def _by_selector(selector: str) -> str:
    """One selector as one regex on the page."""
    if selector[0] in ".#":
        attr, name = ("class", selector[1:]) if selector[0] == "." else ("id", selector[1:])
        return rf"""(?i)<[a-z][^<>]*[\s]{attr}[\s]*=[\s]*["'](?:[^"'<>]*[\s])?{name}(?:[\s][^"'<>]*)?["']"""
    tag, rest = selector.split("[", 1)
    attr, value = rest.rstrip("]").split("*=")
    return rf"""(?i)<{tag or '[a-z][a-z0-9]*'}\b[^<>]*[\s]{attr}[\s]*=[\s]*["'][^"'<>]*{value.strip('"')}"""


_selectors = " + ".join(f"regexp_matches(html, {q(_by_selector(x))})::BIGINT" for x in RULES.block_selectors)
add("block_indicator_tags", f"""{ctes('responses')}, terms AS ({_terms}),
t AS (SELECT page_id, url, status_code, {visible('html')} AS txt, {_title} AS title FROM responses),
sec AS (SELECT page_id, unnest(['text', 'title', 'url', 'service']) AS section, unnest([txt, title, url, txt]) AS hay,
        status_code IN (403, 429, 503, 509) AS suspicious_status, length(txt) < 100 AS low_content FROM t)
SELECT page_id, s.section, language, count(*) FILTER (contains(lower(hay), term)) AS hits, suspicious_status, low_content
FROM sec s JOIN terms k ON k.section = s.section GROUP BY page_id, s.section, language, suspicious_status, low_content
UNION ALL
SELECT r.page_id, 'selector', 'any', {_selectors}, any_value(suspicious_status), any_value(low_content) FROM responses r JOIN sec s ON s.page_id = r.page_id GROUP BY r.page_id, html""")
_quoted = "coalesce(try_cast(regexp_extract(playwright_error, '状态码[：:][\\s]*([0-9]+)', 1) AS BIGINT), 0)"
add("status_from_error", f"""{ctes('lane_results')} SELECT attempt_id, {_quoted} AS quoted,
 CASE WHEN attempt_id % 3 = 0 THEN status_code WHEN {_quoted} <> 0 THEN {_quoted} ELSE 418 END::BIGINT AS resolved FROM lane_results""")


# ---- routing and races ----

def cache_lookup(source: str, key: str, state: str) -> str:
    """Longest state key that equals the host or is a parent of it (keys without a dot are never tried)."""
    return f"""hosts_ AS (SELECT DISTINCT host FROM {source}),
cand AS (SELECT h.host, s.cache_key, s.decision, row_number() OVER (PARTITION BY h.host ORDER BY length(s.cache_key) DESC) AS rn
 FROM hosts_ h JOIN {state} s ON contains(s.cache_key, '.') AND (h.host = s.cache_key OR ends_with(h.host, '.' || s.cache_key))),
cached AS (SELECT u.{key}, c.cache_key, c.decision FROM {source} u LEFT JOIN cand c ON c.host = u.host AND c.rn = 1)"""


add("cached_route", f"""{ctes('odd_urls', 'pdf_urls', 'host_state', 'page_dim')}, {ALL_URLS},
u AS (SELECT kind || '-' || page_id AS id, kind, page_id, {host('url')} AS host FROM all_urls UNION ALL SELECT 'page-' || page_id, 'page', page_id, host FROM page_dim),
{cache_lookup('u', 'id', 'host_state')}
SELECT kind, page_id, coalesce(c.cache_key, '') AS matched_key, coalesce(c.decision, '') AS cached_decision FROM u JOIN cached c ON c.id = u.id""")

_modes = """CASE WHEN decision IS NOT NULL THEN decision WHEN pdf THEN 'pdf' WHEN spa THEN 'playwright' WHEN effective THEN 'easyget'
 WHEN NOT effective THEN 'playwright' ELSE 'race' END"""
add("route", f"""{ctes('odd_urls', 'pdf_urls', 'host_state')}, {ALL_URLS},
u AS (SELECT kind || '-' || page_id AS id, url, {host('url')} AS host, {is_pdf('url')} AS pdf, {under(host('url'), RULES.spa_hosts)} AS spa
      FROM (SELECT kind, page_id, url FROM all_urls UNION ALL SELECT 'page', page_id, url FROM pages)),
{cache_lookup('u', 'id', 'host_state')},
pp AS (SELECT * FROM pages WHERE page_id % 3 <> 0),
{probe_ctes('pp', 'page_id', 'html', 'true', 'CASE WHEN page_id % 5 = 0 THEN 500 ELSE 200 END')},
j AS (SELECT u.*, c.decision, c.cache_key, p.effective, p.text_length AS pn, replace(p.reasons, ',', ', ') AS pr, p.page_id AS pid FROM u JOIN cached c ON c.id = u.id LEFT JOIN probe p ON 'page-' || p.page_id = u.id)
SELECT id, host, {_modes} AS mode, CASE WHEN decision = 'pdf' THEN 'cache_hit_pdf' WHEN decision IS NOT NULL THEN 'cache_hit' WHEN pdf THEN 'pdf_url_pattern'
 WHEN spa THEN 'domain_blacklist' WHEN effective THEN 'easyget_test_success' WHEN NOT effective THEN 'easyget_test_failed' ELSE 'no_probe' END AS method,
 CASE WHEN decision IS NOT NULL THEN 100 WHEN pdf OR spa THEN 95 WHEN effective THEN 85 WHEN NOT effective THEN 80 ELSE 0 END::BIGINT AS confidence,
 CASE WHEN decision IS NOT NULL THEN '缓存决策: ' || cache_key WHEN pdf THEN 'URL模式匹配为PDF文件' WHEN spa THEN '域名在SPA黑名单中'
 WHEN effective THEN concat('EasyGet有效(文字', pn, '字符，状态', CASE WHEN pid % 5 = 0 THEN 500 ELSE 200 END, '，耗时', printf('%.1f', pid % 30 / 10.0), 's)')
 WHEN NOT effective THEN 'EasyGet失败: ' || pr ELSE '' END AS reason, decision IS NOT NULL AS cache_hit FROM j""")
add("lane_plan", f"""{ctes('requests')}, l AS (SELECT request_id, CASE WHEN crawl_type = 'pdf' THEN ['pdf'] WHEN mode = 'fast' THEN ['easyget']
 WHEN mode = 'playwright' THEN ['playwright'] WHEN mode = 'jina' THEN ['jina'] WHEN mode = 'no_jina' THEN ['easyget', 'playwright']
 WHEN hint IN ('pdf', 'easyget') THEN [hint] WHEN hint = 'blocked' THEN [] ELSE ['easyget', 'playwright', 'jina'] END AS ls FROM requests)
SELECT request_id, unnest(range(len(ls))) AS lane_no, unnest(ls) AS lane FROM l UNION ALL SELECT request_id, -1, '' FROM l WHERE len(ls) = 0""")

_prio = "CASE lane WHEN 'easyget' THEN 0 WHEN 'jina' THEN 1 WHEN 'playwright' THEN 2 ELSE 3 END"
_winners = f"""win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY elapsed_s, {_prio}, attempt_id) AS rn
 FROM attempts WHERE success) WHERE rn = 1)"""
add("race_winner", f"{ctes('attempts')}, {_winners} SELECT request_id, attempt_id, lane, elapsed_s FROM win")
add("race_winner_first_finisher", f"""{ctes('attempts')}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY elapsed_s, {_prio}, attempt_id) AS fin,
 row_number() OVER (PARTITION BY request_id, success ORDER BY {_prio}, elapsed_s, attempt_id) AS pr FROM attempts),
f AS (SELECT * FROM r WHERE fin = 1), o AS (SELECT * FROM r WHERE success AND pr = 1)
SELECT f.request_id, CASE WHEN f.success THEN f.attempt_id ELSE o.attempt_id END AS attempt_id, CASE WHEN f.success THEN f.lane ELSE o.lane END AS lane,
 CASE WHEN f.success THEN f.elapsed_s ELSE o.elapsed_s END AS elapsed_s FROM f LEFT JOIN o ON o.request_id = f.request_id WHERE f.success OR o.request_id IS NOT NULL""")
_none = "任务返回None（可能被取消或超时）"
add("race_failures", f"""{ctes('attempts', 'lane_results')},
cause AS (SELECT attempt_id, {_cause} AS cause FROM lane_results WHERE NOT success),
g AS (SELECT request_id, min(url) AS url, coalesce(max(cause) FILTER (lane = 'easyget'), '{_none}') AS easyget_error,
 coalesce(max(cause) FILTER (lane = 'playwright'), '{_none}') AS playwright_error, coalesce(max(cause) FILTER (lane = 'jina'), '{_none}') AS jina_error, max(cause) FILTER (lane = 'pdf') AS pdf_error,
 max(status_code) FILTER (lane = 'playwright') AS pb, max(status_code) FILTER (lane = 'jina') AS pj
 FROM lane_results a LEFT JOIN cause c ON c.attempt_id = a.attempt_id GROUP BY request_id HAVING NOT bool_or(success))
SELECT request_id, url, easyget_error, playwright_error, jina_error, pdf_error,
 coalesce(pb, try_cast(regexp_extract(playwright_error, '状态码[：:][\\s]*([0-9]+)', 1) AS INT), pj) AS status_code,
 concat('# 爬取失败', chr(10), chr(10), '**URL:** ', url, chr(10), chr(10), '**失败原因:** EasyGet: ', easyget_error, ' | Playwright: ', playwright_error,
  ' | Jina: ', jina_error, CASE WHEN pdf_error IS NULL THEN '' ELSE ' | PDF: ' || pdf_error END) AS markdown, 'blocked' AS decision FROM g""")
_res = f"""{_winners}, res AS (SELECT a.request_id, bool_or(a.success) AS success, coalesce(any_value(w.elapsed_s), max(a.elapsed_s)) AS elapsed_s
 FROM attempts a LEFT JOIN win w ON w.request_id = a.request_id GROUP BY a.request_id)"""
add("batch_summary", f"""{ctes('batch_requests', 'attempts')}, {_res}
SELECT batch_id, count(*) AS total_urls, count(*) FILTER (success) AS successful, count(*) FILTER (NOT coalesce(success, false)) AS failed,
 count(*) FILTER (success IS NULL) AS missing, coalesce(max(elapsed_s), 0) AS max_time, round(coalesce(sum(elapsed_s), 0), 3) AS total_time
FROM batch_requests b LEFT JOIN res r ON r.request_id = b.request_id GROUP BY batch_id""")
add("batch_code", f"""{ctes('attempts')}, {_res} SELECT CAST(floor(request_id / 4) AS BIGINT) AS batch_id, CASE WHEN bool_and(success) THEN 0 ELSE 1 END AS code,
 CASE WHEN bool_and(success) THEN '爬取完成' ELSE '部分URL爬取失败' END AS msg FROM res GROUP BY floor(request_id / 4)""")
add("split_outcomes", f"{ctes('attempts')}, {_res} SELECT request_id, CASE WHEN success THEN 'ok' ELSE 'failed' END AS outcome FROM res")
add("route_accuracy", f"""{ctes('attempts', 'host_state')}, {_winners},
u AS (SELECT request_id, url, host, lane, {is_pdf('url')} AS pdf, {under(host('url'), RULES.spa_hosts)} AS spa, NULL::BOOLEAN AS effective FROM win),
{cache_lookup('u', 'request_id', 'host_state')},
m AS (SELECT {_modes} AS predicted, lane AS actual FROM u JOIN cached c ON c.request_id = u.request_id),
n AS (SELECT predicted, actual, count(*) AS n FROM m GROUP BY predicted, actual)
SELECT predicted, actual, n, round(n / sum(n) OVER (PARTITION BY predicted), 6) AS precision,
 round((SELECT count(*) FILTER (predicted = actual) / count(*) FROM m), 6) AS accuracy FROM n""")


# ---- learned state ----

def fold(events: str, start: str) -> str:
    """Event by event, per host, in time order (recursive)."""
    return f"""ev AS (SELECT host, lane, CASE WHEN success THEN 1 ELSE -1 END AS delta,
  row_number() OVER (PARTITION BY host ORDER BY ts, attempt_id) AS rn FROM {events}),
f(host, rn, decision, score) AS (
 SELECT h.host, 0::BIGINT, s.decision, coalesce(s.score, 0)::INT FROM (SELECT DISTINCT host FROM {events}) h LEFT JOIN {start} s ON s.cache_key = h.host
 UNION ALL
 SELECT f.host, ev.rn, CASE WHEN f.score <= 0 AND ev.delta < 0 THEN NULL ELSE ev.lane END,
  CASE WHEN f.score <= 0 THEN greatest(ev.delta, 0) WHEN f.decision = ev.lane THEN greatest(0, f.score + ev.delta) ELSE 1 END
 FROM f JOIN ev ON ev.host = f.host AND ev.rn = f.rn + 1),
fin AS (SELECT host, arg_max({{'d': decision, 's': score}}, rn) AS e, max(rn) AS n FROM f GROUP BY host)"""


add("learn_scores", f"""{ctes('attempts', 'host_state').replace('WITH ', 'WITH RECURSIVE ', 1)}, {fold('attempts', 'host_state')}
SELECT host AS cache_key, e.d AS decision, e.s::BIGINT AS score, n::BIGINT AS events FROM fin WHERE e.s > 0
UNION ALL SELECT cache_key, decision, score, 0 FROM host_state WHERE cache_key NOT IN (SELECT host FROM attempts)""")
add("nested_markdown", f"""WITH {block_ctes()}, {_pages_md},
every AS (SELECT page_id, string_agg({_md}, chr(10) || chr(10) ORDER BY pos) AS markdown FROM
 (SELECT page_id, pos, tag, seg, CASE WHEN regexp_matches(seg, {q(INLINE)}) THEN {_flat(_inline('seg'))} ELSE text END AS flat FROM blocks) GROUP BY page_id)
SELECT p.page_id, replace(concat('## L', p.page_id, '~~- a', p.page_id, '~  1. x~  2. y', p.page_id, '~     - z~  3. w~- b~~| k | v\\|w |~| --- | --- |~| ',
 p.page_id, ' |  |~| p q | ', length(p.html), ' |'), '~', chr(10)) || coalesce(chr(10) || chr(10) || e.markdown, '') AS markdown, coalesce(m.markdown, '') AS main
FROM pages p LEFT JOIN every e ON e.page_id = p.page_id LEFT JOIN page_md m ON m.page_id = p.page_id""")
add("bm25_corpus", ORACLES["bm25_blocks"].replace("st AS (SELECT page_id, count(*) AS n, avg(len(ts)) AS mean FROM tk GROUP BY page_id)",
    "st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM tk)").replace("SELECT page_id, w, count(*) FILTER (f > 0) AS d FROM tf GROUP BY page_id, w",
    "SELECT w, count(*) FILTER (f > 0) AS d FROM tf GROUP BY w").replace("JOIN df ON df.page_id = tf.page_id AND df.w = tf.w JOIN st ON st.page_id = tf.page_id",
    "JOIN df ON df.w = tf.w CROSS JOIN st"))
add("loaded_patterns", f"""{ctes('pdf_urls', 'url_patterns')} SELECT page_id, p.pattern FROM pdf_urls,
 (SELECT DISTINCT lower(pattern) AS pattern FROM url_patterns WHERE pattern <> '') p WHERE contains(lower(url), p.pattern)""")
add("cached_route_hot", ORACLES["cached_route"])
add("latency_sketch", f"""{ctes('attempts')}, a AS (SELECT list_extract(string_split(host, '.'), -1) AS "case", CASE WHEN lane IN ('easyget', 'playwright', 'jina', 'pdf') THEN lane ELSE 'other' END AS lane,
 elapsed_s * 1000 AS ms FROM attempts WHERE elapsed_s IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY "case", lane ORDER BY ms) AS k, count(*) OVER (PARTITION BY "case", lane) AS n FROM a),
p AS (SELECT "case", lane, any_value(n) AS n, min(ms) FILTER (k >= ceil(0.5 * n)) AS p50, min(ms) FILTER (k >= ceil(0.95 * n)) AS p95 FROM r GROUP BY 1, 2)
SELECT "case", lane, n, {_bucketed('p50')} AS p50_ms, {_bucketed('p95')} AS p95_ms FROM p""")
# The stream is closed at its end, so every event is folded.
add("learn_scores_stream", f"""{ctes('attempts').replace('WITH ', 'WITH RECURSIVE ', 1)},
nothing AS (SELECT '' AS cache_key, '' AS decision, 0 AS score WHERE false), {fold('attempts', 'nothing')}
SELECT host AS cache_key, e.d AS decision, e.s::BIGINT AS score FROM fin WHERE e.s > 0""")
_pdf_attempts = f"pa AS (SELECT attempt_id, ts, success, url, {host('url')} AS host FROM pdf_attempts)"
_learned = f"count(*) FILTER (success) >= {RULES.pdf_learn_threshold} AND host NOT IN ({', '.join(map(q, RULES.pdf_hosts))})"
add("learn_pdf_hosts", f"""{ctes('pdf_attempts')}, {_pdf_attempts}
SELECT host, count(*) AS total_attempts, count(*) FILTER (success) AS success_count, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us,
 {_learned} AS learned FROM pa GROUP BY host""")
add("learn_pdf_paths", f"""{ctes('pdf_attempts')}, {_pdf_attempts},
hit AS (SELECT host, string_split({path('url')}, '/') AS ps FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts, attempt_id) AS rn FROM pa WHERE success)
 WHERE rn = {RULES.pdf_learn_threshold} AND host NOT IN ({', '.join(map(q, RULES.pdf_hosts))})),
x AS (SELECT host, ps, unnest(range(1, len(ps) + 1)) AS i FROM hit)
SELECT DISTINCT host, array_to_string(ps[:i], '/') || '/' AS pattern FROM x WHERE contains(lower(ps[i]), 'pdf')
 AND array_to_string(ps[:i], '/') || '/' NOT IN ({', '.join(map(q, RULES.pdf_patterns))})""")
add("cap_state", f"""{ctes('attempts').replace('WITH ', 'WITH RECURSIVE ', 1)}, nothing AS (SELECT '' AS cache_key, '' AS decision, 0 AS score WHERE false),
{fold('attempts', 'nothing')}, u AS (SELECT host, max(ts) AS ts FROM attempts GROUP BY host)
SELECT fin.host AS cache_key, epoch_us(ts) AS updated_us FROM fin JOIN u ON u.host = fin.host WHERE e.s > 0 ORDER BY ts DESC, fin.host LIMIT 20""")
add("state_stats", f"""{ctes('pdf_attempts', 'host_state')}, {_pdf_attempts}
SELECT count(*) AS cache_size, {', '.join(f"count(*) FILTER (decision = '{d}') AS n_{d}" for d in ('easyget', 'playwright', 'jina', 'pdf', 'blocked'))},
 sum(score)::BIGINT AS total_score, (SELECT count(*) FROM (SELECT host FROM pa GROUP BY host HAVING {_learned})) AS learned_pdf_hosts,
 {len(RULES.spa_hosts)}::BIGINT AS spa_hosts, {len(RULES.spa_patterns)}::BIGINT AS spa_patterns, {len(RULES.pdf_hosts)}::BIGINT AS pdf_hosts,
 {len(RULES.pdf_patterns)}::BIGINT AS pdf_patterns, 500::BIGINT AS body_text_threshold, 10::BIGINT AS script_count_threshold, 2::BIGINT AS min_criteria_match,
 {RULES.pdf_learn_threshold}::BIGINT AS pdf_learn_threshold FROM host_state""")

# ---- ranking, windows, retention ----

add("usage_rollup", f"{ctes('uses')} SELECT endpoint_id, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_used, count(*) AS uses FROM uses GROUP BY endpoint_id")
_special = ", ".join(map(q, R.SPECIAL_ENDPOINTS))
_fit = f"fit AS (SELECT * FROM endpoints WHERE delay_ms > 0 AND endpoint_id <> 7 AND coalesce(name NOT IN ({_special}), true))"
add("candidate_scores", f"""{ctes('endpoints', 'uses')}, {_fit},
us AS (SELECT endpoint_id, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_used FROM uses GROUP BY endpoint_id),
s AS (SELECT grp, f.endpoint_id, round(CAST(0.7 AS DOUBLE) * ((max(delay_ms) OVER g - delay_ms) / greatest(1, max(delay_ms) OVER g - min(delay_ms) OVER g))
  + (CAST(1.0 AS DOUBLE) - CAST(0.7 AS DOUBLE)) * CASE WHEN last_used IS NULL THEN 1.0 ELSE least(1.0, greatest(0, {P.NOW_EPOCH} - last_used) / {86400 * 3}.0) END, 9) AS score
  FROM fit f LEFT JOIN us ON us.endpoint_id = f.endpoint_id WINDOW g AS (PARTITION BY grp)),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, endpoint_id) AS rank FROM s)
SELECT grp, endpoint_id, score, rank FROM r WHERE rank <= 3""")
add("eligible_endpoints", f"""{ctes('endpoints', 'uses')}, {_fit} SELECT endpoint_id, delay_ms FROM fit
WHERE NOT coalesce({has_any('name', ('香港', 'HK', 'Hong Kong', 'HongKong'))}, false)
 AND endpoint_id NOT IN (SELECT endpoint_id FROM uses GROUP BY endpoint_id HAVING count(*) >= 5)""")

S = P.STABLE


def stability(source: str) -> str:
    """Check by check, per page (recursive), as the polling loop does."""
    return f"""ob AS (SELECT page_key, event_id, epoch_us(ts) AS us, text_len AS n, contains(text, 'Seems like you lost connectivity') AS err,
  row_number() OVER (PARTITION BY page_key ORDER BY ts, event_id) - 1 AS rn FROM {source}),
w(page_key, rn, event_id, start, us, ini, n, err, checks, stable, zero, errors) AS (
 SELECT page_key, rn, event_id, us, us, n, n, err, 0::BIGINT, 0::BIGINT, CASE WHEN n = 0 THEN 1 ELSE 0 END::BIGINT, 0::BIGINT FROM ob WHERE rn = 0
 UNION ALL
 SELECT w.page_key, o.rn, o.event_id, w.start, o.us, w.ini, o.n, o.err, w.checks + 1,
  CASE WHEN o.err THEN 0 WHEN w.checks + 1 > 1 AND abs(o.n - w.n) <= {S['delta']} AND o.n > 0 THEN w.stable + 1 WHEN w.checks + 1 > 1 THEN 0 ELSE w.stable END,
  CASE WHEN o.err THEN w.zero WHEN o.n = 0 THEN w.zero + 1 ELSE 0 END, w.errors + o.err::INT
 FROM w JOIN ob o ON o.page_key = w.page_key AND o.rn = w.rn + 1),
jd AS (SELECT *, CASE WHEN rn = 0 OR err THEN NULL WHEN zero >= {S['zero_n']} THEN 'zero_text_threshold'
  WHEN n >= {S['min_chars']} AND stable >= {S['stable_n']} THEN 'stable' WHEN (us - start) / 1000 > {S['timeout_ms']} THEN 'forced_timeout' END AS reason FROM w),
fst AS (SELECT page_key, min(rn) AS rn FROM jd WHERE reason IS NOT NULL GROUP BY page_key)
SELECT jd.page_key, reason, event_id, (us - start) / 1000 AS wait_ms, checks AS check_count, stable AS stable_count, zero AS zero_count,
 errors AS connectivity_wait_count, ini AS initial_length, n AS final_length, round((n - ini) / greatest(ini, 1), 6) AS growth_ratio
FROM jd JOIN fst ON fst.page_key = jd.page_key AND fst.rn = jd.rn"""


add("text_stability", f"{ctes('obs').replace('WITH ', 'WITH RECURSIVE ', 1)}, {stability('obs')}")
add("text_stability_stream", f"""{ctes('obs').replace('WITH ', 'WITH RECURSIVE ', 1)}, {stability('obs')}""")
_ms = "elapsed_s * 1000"
add("visit_curve", f"""{ctes('attempts')}, v AS (SELECT {_ms} AS ms, row_number() OVER (PARTITION BY host ORDER BY ts, attempt_id) AS n FROM attempts)
SELECT CASE WHEN n >= 5 THEN '5+' ELSE CAST(n AS VARCHAR) END AS visit, count(*) AS visits, round(avg(ms), 4) AS avg_ms, round(quantile_cont(ms, 0.5), 4) AS p50_ms
FROM v GROUP BY 1""")
_lane_cols = ", ".join(
    f"count(*) FILTER (lane = '{x}') AS {x}_n, round(count(*) FILTER (lane = '{x}' AND success) / count(*) FILTER (lane = '{x}'), 6) AS {x}_success_rate, "
    f"round(avg(ms) FILTER (lane = '{x}'), 4) AS {x}_avg_ms, round(quantile_cont(ms, 0.5) FILTER (lane = '{x}'), 4) AS {x}_p50_ms, "
    f"round(quantile_cont(ms, 0.95) FILTER (lane = '{x}'), 4) AS {x}_p95_ms, round(max(ms) FILTER (lane = '{x}'), 4) AS {x}_max_ms" for x in (*R.LANES, "other"))
add("latency_table", f"""{ctes('attempts')}, a AS (SELECT list_extract(string_split(host, '.'), -1) AS "case", lane, success, {_ms} AS ms FROM attempts)
SELECT "case", {_lane_cols} FROM a GROUP BY 1""")
add("file_inventory_totals", f"""{ctes('files')} SELECT count(*) AS total_files, sum(file_size)::BIGINT AS total_size,
 round(sum(file_size) / 1048576.0, 2) AS total_size_mb FROM files""")
add("file_inventory_newest", f"{ctes('files')} SELECT file_id, filename, file_size FROM files WHERE download_time IS NOT NULL ORDER BY download_time DESC, file_id LIMIT 20")
_fate = f"""CASE WHEN download_time IS NULL THEN 'invalid' WHEN download_time < TIMESTAMP '{P.RETENTION_NOW}' - INTERVAL {P.RETENTION_HOURS} HOUR THEN 'expire' ELSE 'keep' END"""
add("retention_split", f"{ctes('files')} SELECT file_id, {_fate} AS fate, {_fate} <> 'keep' AS removed FROM files")
add("retention_summary", f"""{ctes('files')} SELECT {_fate} AS fate, count(*) AS files, sum(file_size)::BIGINT AS bytes,
 round(sum(file_size) / 1048576.0, 2) AS mb FROM files GROUP BY 1""")
add("stream_progress", f"""{ctes('attempts')} SELECT epoch_us(date_trunc('hour', ts)) AS window_us, lane, count(*) AS started, count(*) FILTER (success) AS done,
 count(*) FILTER (NOT success) AS failed FROM attempts GROUP BY 1, 2""")
add("progress_with_late", f"""{ctes('attempts')}, mark AS (SELECT max(ts) - INTERVAL 10 minutes AS m FROM attempts WHERE attempt_id % 10 <> 3),
a AS (SELECT *, attempt_id % 10 = 3 AND ts < m AS late FROM attempts, mark)
SELECT epoch_us(date_trunc('hour', ts)) AS window_us, lane, count(*) FILTER (NOT late) AS started, count(*) FILTER (NOT late AND success) AS done,
 count(*) FILTER (NOT late AND NOT success) AS failed, count(*) FILTER (late) AS late FROM a GROUP BY 1, 2""")
add("host_report", f"""{ctes('page_dim')}, {health_ctes('page_dim', 'page_id', visible('html'), 'NULL', 2000)},
s AS (SELECT p.host, h.reason, CAST(round(greatest(0.0, round(CAST(length(html) - length({_clean}) AS DOUBLE) / greatest(1, length(html)) * 100, 2)) * 100) AS BIGINT) AS saved,
 {is_pdf('url')} AS pdf, {under(host('url'), RULES.spa_hosts)} AS spa FROM page_dim p JOIN health h ON h.page_id = p.page_id),
r AS (SELECT host, reason, count(*) AS n, row_number() OVER (PARTITION BY host ORDER BY count(*) DESC, reason DESC) AS rn FROM s WHERE reason <> '' GROUP BY host, reason)
SELECT s.host, count(*) AS pages, count(*) FILTER (s.reason = '') AS healthy, coalesce(any_value(r.reason), '') AS top_reason,
 round(sum(saved) / count(*) / 100, 4) AS mean_reduction, CASE WHEN bool_or(pdf) THEN 'pdf' WHEN bool_or(spa) THEN 'playwright' ELSE 'race' END AS route
FROM s LEFT JOIN r ON r.host = s.host AND r.rn = 1 GROUP BY s.host""")

_re = f"""win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY elapsed_s, {_prio}, attempt_id) AS rn FROM attempts WHERE success) WHERE rn = 1),
lost AS (SELECT request_id, min(url) AS url, min(host) AS host, max(ts) AS ts FROM attempts GROUP BY request_id HAVING NOT bool_or(success)),
re AS (SELECT host, ts, request_id AS attempt_id, lane, true AS success FROM win
 UNION ALL SELECT host, ts, request_id, CASE WHEN {is_pdf('url')} THEN 'pdf' ELSE 'blocked' END, NOT ({is_pdf('url')}) FROM lost)"""
add("resolved_events", f"""{ctes('attempts')}, {_re} SELECT host, attempt_id AS event_id, lane, CASE WHEN success THEN 1 ELSE -1 END::BIGINT AS delta, epoch_us(ts) AS ts_us FROM re""")
add("learn_scores_resolved", f"""{ctes('attempts', 'host_state').replace('WITH ', 'WITH RECURSIVE ', 1)}, {_re}, {fold('re', 'host_state')}
SELECT host AS cache_key, e.d AS decision, e.s::BIGINT AS score, n::BIGINT AS events FROM fin WHERE e.s > 0
UNION ALL SELECT cache_key, decision, score, 0 FROM host_state WHERE cache_key NOT IN (SELECT host FROM re)""")
add("route_learned", f"""{ctes('odd_urls', 'pdf_urls', 'host_state')}, {ALL_URLS},
lh AS (SELECT host FROM ({ORACLES['learn_pdf_hosts']}) WHERE learned), lp AS (SELECT DISTINCT pattern FROM ({ORACLES['learn_pdf_paths']})),
tk AS (SELECT DISTINCT {host('url')} || ':' || {template('url')} AS cache_key FROM pdf_urls WHERE {is_pdf('url')} AND {template('url')} <> {path('url')}),
u AS (SELECT kind || '-' || page_id AS id, url, {host('url')} AS host, {is_pdf('url')} AS pdf0, {under(host('url'), RULES.spa_hosts)} AS spa FROM all_urls),
v AS (SELECT *, pdf0 OR (contains(host, '.') AND EXISTS (SELECT 1 FROM lh WHERE contains(lh.host, '.') AND (u.host = lh.host OR ends_with(u.host, '.' || lh.host))))
  OR EXISTS (SELECT 1 FROM lp WHERE contains(lower(u.url), lower(lp.pattern))) AS pdf, host || ':' || {template('url')} AS tkey FROM u),
{cache_lookup('v', 'id', 'host_state')},
j AS (SELECT v.*, coalesce(CASE WHEN t.cache_key IS NOT NULL THEN 'pdf' END, c.decision) AS decision, coalesce(t.cache_key, c.cache_key) AS hit, NULL::BOOLEAN AS effective
 FROM v JOIN cached c ON c.id = v.id LEFT JOIN tk t ON t.cache_key = v.tkey)
SELECT id, {_modes} AS mode, CASE WHEN decision = 'pdf' THEN 'cache_hit_pdf' WHEN decision IS NOT NULL THEN 'cache_hit' WHEN pdf THEN 'pdf_url_pattern'
 WHEN spa THEN 'domain_blacklist' ELSE 'no_probe' END AS method,
 CASE WHEN decision IS NOT NULL THEN '缓存决策: ' || hit WHEN pdf THEN 'URL模式匹配为PDF文件' WHEN spa THEN '域名在SPA黑名单中' ELSE '' END AS reason FROM j""")
add("running_totals", f"""{ctes('attempts')} SELECT lane, count(*) AS started, count(*) FILTER (success) AS done, count(*) FILTER (NOT success) AS failed FROM attempts GROUP BY lane""")
add("candidate_picks", f"SELECT grp, count(*) AS best, 1 AS picked FROM ({ORACLES['candidate_scores']}) GROUP BY grp")
