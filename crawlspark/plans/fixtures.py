"""Deterministic views over the given tables, as one SQL text that Spark and DuckDB both run unchanged.

``{name}`` stands for a base table or another view. :func:`view` builds the Spark DataFrame, :func:`ctes` the
WITH list for the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("pages", "documents", "events", "orders", "supplier")

# What the lane results hold besides the text they brought.
_LANE_HEAD = """a.attempt_id, a.request_id, a.ts, a.url, a.host,
       CASE WHEN a.attempt_id % 31 = 7 THEN NULL ELSE a.lane END AS lane, a.success, a.status_code, a.elapsed_s,"""
_LANE_TAIL = """       CASE WHEN a.lane = 'easyget' AND NOT a.success AND a.attempt_id % 5 = 0 THEN 'quality_check_failed' END AS easyget_error,
       CASE WHEN a.lane = 'playwright' AND NOT a.success AND a.attempt_id % 2 = 0
            THEN concat('页面访问失败，状态码: ', CAST(a.status_code AS VARCHAR(9))) END AS playwright_error,
       CAST(NULL AS VARCHAR(99)) AS jina_error,
       CASE WHEN a.lane = 'pdf' AND NOT a.success AND a.attempt_id % 2 = 0 THEN 'pdf broken' END AS pdf_error
FROM (SELECT *, attempt_id % (2 * (SELECT n FROM {body_count})) AS at_body FROM {attempts}) a
"""

VIEWS = {
    "page_dim": """
SELECT page_id, url, html,
       regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www[.]', '') AS host
FROM {pages}""",
    "page_count": "SELECT count(*) AS n FROM {pages}",
    "body_count": "SELECT count(*) AS n FROM {documents}",
    "attempts": """
SELECT e.event_id AS attempt_id, e.request_id, e.ts, p.url, p.host,
       CASE WHEN e.event_id % 29 = 11 THEN 'pdf' WHEN e.event_id % 3 = 0 THEN 'easyget' WHEN e.event_id % 3 = 1 THEN 'playwright' ELSE 'jina' END AS lane,
       e.event_type <> 'error' AS success,
       CASE WHEN e.event_type <> 'error' THEN 200 WHEN e.user_id % 4 = 0 THEN 403
            WHEN e.user_id % 4 = 1 THEN 429 WHEN e.user_id % 4 = 2 THEN 500 ELSE 200 END AS status_code,
       CASE WHEN e.event_id % 37 = 5 THEN NULL ELSE e.value / 10 END AS elapsed_s
FROM (SELECT event_id, ts, user_id, event_type, value, CAST(floor(event_id / 3) AS BIGINT) AS request_id,
             CAST(floor(event_id / 3) AS BIGINT) % (SELECT n FROM {page_count}) AS at_page FROM {events}) e
JOIN {page_dim} p ON p.page_id = e.at_page""",
    "bodies": """
SELECT doc_id AS body_id, text,
       CASE doc_id % 40 WHEN 9 THEN 401 WHEN 10 THEN 403 WHEN 11 THEN 429 WHEN 21 THEN 500 ELSE 200 END AS status_code
FROM {documents}
UNION ALL
SELECT doc_id + (SELECT n FROM {body_count}),
       CASE doc_id % 12 WHEN 0 THEN '' WHEN 1 THEN 'Just a moment... Checking with Cloudflare'
            WHEN 2 THEN 'Please enable JavaScript to continue' WHEN 3 THEN 'Complete the captcha below'
            WHEN 4 THEN 'request timed out' WHEN 5 THEN 'body too short' WHEN 6 THEN substr(text, 1, 120)
            WHEN 7 THEN concat(repeat(text, 20), ' captcha cloudflare timed out') WHEN 8 THEN '请完成验证码'
            ELSE text END AS text,
       CASE doc_id % 40 WHEN 9 THEN 401 WHEN 10 THEN 403 WHEN 11 THEN 429 WHEN 21 THEN 500 ELSE 200 END AS status_code
FROM {documents}""",
    "lane_results": """
SELECT """ + _LANE_HEAD + """
       CASE WHEN a.attempt_id % 4 = 3 THEN NULL ELSE b.text END AS markdown,
       CASE WHEN a.attempt_id % 4 = 3 THEN concat('<style>p</style><p>', b.text, '</p>') END AS html,
""" + _LANE_TAIL + """JOIN {bodies} b ON b.body_id = a.at_body""",
    # The same without the text: which body, and whether as HTML.
    "lane_heads": """
SELECT """ + _LANE_HEAD + """
       a.at_body, a.attempt_id % 4 = 3 AS in_html,
""" + _LANE_TAIL.rstrip("\n"),
    "spa_pages": """
SELECT page_id, url, html FROM {pages}
UNION ALL
SELECT page_id + 1000000, url,
       CASE page_id % 5 WHEN 0 THEN concat('<script src="/a/main_0a1b.js"></script>', html)
            WHEN 1 THEN '<html><head><script src="/react-dom.min.js"></script></head><body><div id="root"></div></body></html>'
            WHEN 2 THEN concat('<html><body>', repeat('<script src="x.js"></script>', 12), '<p>hi</p></body></html>')
            WHEN 3 THEN '<html><body><app-root></app-root></body></html>'
            ELSE concat('<meta name="viewport"><meta name="generator"><meta name="theme-color">', html) END AS html
FROM {pages}""",
    "rich_pages": """
SELECT page_id, url,
       concat('<link rel="icon" href="/i/', page_id, '.png"><img alt="a" src="data:image/png;base64,QUJD">',
              '<noscript>n</noscript><script src="a.js"/>',
              CASE WHEN page_id % 3 = 0 THEN '<div class="x g-recaptcha BLOCKED" id="captcha"><iframe src="https://a/recaptcha/api"></iframe></div>' ELSE '' END,
              CASE WHEN page_id % 4 = 0 THEN '<embed type="application/pdf">' ELSE '' END, html) AS html
FROM {pages}""",
    "url_patterns": """
SELECT DISTINCT CASE page_id % 6 WHEN 0 THEN upper(substr(url, 9 + page_id % 17, 3 + page_id % 9)) WHEN 1 THEN substr(url, 20, 12)
       WHEN 2 THEN concat('nowhere-', page_id) WHEN 3 THEN substr(url, 12, 2) WHEN 4 THEN substr(url, 10 + page_id % 13, 5) ELSE '' END AS pattern
FROM {pdf_urls}""",
    "listed_pages": """
SELECT page_id, html AS plain,
       concat('<article><h2>L', page_id, '</h2><UL><li>a', page_id, '<ol start="1"><li>x<li>y', page_id, '<ul><li>z</ul><li><p>w</p></ol></li>',
              '<li>b</UL><table class="t"><tr><th>k<th>v|w</tr><tr><td>', page_id, '<td></td></tr><tr><td>p<ul><li>q</ul></td><td>',
              length(html), '</table></article>', html) AS html
FROM {pages}""",
    "icon_pages": """
SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN html
       WHEN 1 THEN concat('<head><link rel="apple-touch-icon" href="t.png"><link rel="shortcut icon" href="//cdn.x/s.ico">',
                          '<link rel="icon" href="/i/', page_id, '.png"><link rel="icon" href="https://o.x/p.png"></head>', html)
       WHEN 2 THEN concat('<link href="img/f.ico?v=', page_id, '" rel="Shortcut Icon"><link rel="stylesheet" href="a.css">', html)
       ELSE concat(repeat(' ', 10000), '<link rel="icon" href="/late.png">', html) END AS html
FROM {pages}""",
    "pdf_urls": """
SELECT page_id, url FROM {pages}
UNION ALL
SELECT page_id + 1000000, CASE page_id % 9 WHEN 0 THEN url WHEN 1 THEN concat('https://a.example.com/d/Paper', page_id, '.PDF')
            WHEN 2 THEN concat('https://arxiv.org/abs/', page_id) WHEN 3 THEN concat('https://www.arxiv.org/pdf/', page_id)
            WHEN 4 THEN concat('https://papers.openreview.net/forum?id=', page_id)
            WHEN 5 THEN concat('https://x.example.com/get?format=pdf&n=', page_id)
            WHEN 6 THEN 'https://www.nature.com/articles/s1' WHEN 7 THEN 'https://y.example.com/viewPDF/7'
            ELSE concat('https://z.example.com:8080/a/pdf-store/', page_id, '.pdf?dl=1') END AS url
FROM {pages}""",
    "odd_urls": """
SELECT page_id, url FROM {pages}
UNION ALL
SELECT page_id + 1000000, CASE page_id % 10 WHEN 0 THEN url WHEN 1 THEN concat('HTTP://WWW.Example.COM:8080/a;x=1?q=', page_id, '#frag')
            WHEN 2 THEN 'http://zhihu.com/question/1' WHEN 3 THEN 'https://zhuanlan.zhihu.com/p/2?x=1' WHEN 4 THEN 'mailto:a@b.c'
            WHEN 5 THEN '//cdn.example.org/lib.js' WHEN 6 THEN 'http://localhost/x' WHEN 7 THEN 'http://gist.github.com?a=b'
            WHEN 8 THEN concat('https://www.biorxiv.org/content/10.', page_id, '/v1.full+text.pdf')
            ELSE concat('https://proceedings.mlr.press/v139/dong', page_id, 'a/a%20b+c.pdf') END AS url
FROM {pages}""",
    "pdf_attempts": """
SELECT a.attempt_id, a.ts, a.success, u.url
FROM (SELECT attempt_id, ts, success, attempt_id % (SELECT n FROM {page_count})
             + CASE WHEN attempt_id % 3 = 0 THEN 1000000 ELSE 0 END + CASE WHEN attempt_id % 2 = 0 THEN 100000000 ELSE 0 END AS at_url FROM {attempts}) a
JOIN (SELECT page_id, url FROM {odd_urls} UNION ALL SELECT page_id + 100000000, url FROM {pdf_urls}) u ON u.page_id = a.at_url""",
    "responses": """
SELECT r.page_id, u.url, r.html,
       CASE r.page_id % 6 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'Application/PDF' WHEN 2 THEN 'application/octet-stream'
            WHEN 3 THEN NULL ELSE 'text/html' END AS content_type,
       CASE r.page_id % 7 WHEN 0 THEN 'attachment; filename="Report.pdf"' WHEN 1 THEN 'inline'
            WHEN 2 THEN concat('attachment; FileName=x', r.page_id, '.bin; filename=y') WHEN 3 THEN '' END AS disposition,
       CASE r.page_id % 11 WHEN 3 THEN 404 ELSE 200 END AS status_code,
       CASE r.page_id % 10 WHEN 0 THEN unhex('255044462D312E37') WHEN 1 THEN unhex('89504E470D0A1A0A') WHEN 2 THEN unhex('474946383961')
            WHEN 3 THEN unhex('FFD8FFE0') WHEN 4 THEN unhex('504B0304') WHEN 5 THEN unhex('1F8B08') WHEN 6 THEN unhex('424D00')
            WHEN 7 THEN unhex('00000100') WHEN 8 THEN unhex('3C68746D6C') END AS body
FROM {rich_pages} r JOIN {pdf_urls} u ON u.page_id = r.page_id + 1000000""",
    "requests": """
SELECT page_id AS request_id,
       concat(url, '|', CASE page_id % 11 WHEN 3 THEN '' WHEN 4 THEN '  ' ELSE url END, '|', url) AS url_list,
       CASE page_id % 7 WHEN 0 THEN 'normal' WHEN 1 THEN 'fast' WHEN 2 THEN 'playwright' WHEN 3 THEN 'jina' WHEN 4 THEN 'no_jina'
            WHEN 5 THEN 'turbo' END AS mode,
       CASE page_id % 5 WHEN 0 THEN 'web' WHEN 1 THEN 'auto' WHEN 2 THEN 'zip' WHEN 3 THEN 'pdf' ELSE 'auto' END AS crawl_type,
       CASE page_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'easyget' WHEN 2 THEN 'blocked' WHEN 3 THEN 'race' END AS hint
FROM {pages}""",
    "markdown_docs": """
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN text WHEN 1 THEN concat('Title:  Doc ', doc_id, ' ', chr(10), text)
            WHEN 2 THEN concat('URL Source: x', chr(10), 'Markdown Content:', chr(10), text)
            WHEN 3 THEN concat('Head ', doc_id, chr(10), chr(10), '===============', chr(10), '# no', chr(10), text)
            WHEN 4 THEN concat('intro', chr(10), '## Two ', doc_id, chr(10), text)
            WHEN 5 THEN concat('===============', chr(10), '  # One ', doc_id, chr(10), text)
            WHEN 6 THEN concat('![a](data:image/png;base64,QUJD)', chr(10), '[l](data:image/gif;base64,QQ==) ', text,
                               ' data:image/png;base64,AAAA')
            ELSE concat('see [one](http://a.b/c) and ![pic](/p.png) [two](d)[three](e) ', text) END AS md
FROM {documents}""",
    "big_pages": "SELECT page_id, url, repeat(html, CAST(1 + page_id % 12 AS INTEGER)) AS html FROM {pages}",
    "host_state": """
SELECT regexp_replace(host, '^blog[.]', '') AS cache_key,
       CASE CAST(floor(min(page_id) / 2) AS BIGINT) % 4 WHEN 0 THEN 'easyget' WHEN 1 THEN 'playwright' WHEN 2 THEN 'jina'
            ELSE 'blocked' END AS decision,
       CAST(1 + min(page_id) % 3 AS INTEGER) AS score
FROM {page_dim} GROUP BY regexp_replace(host, '^blog[.]', '')""",
    "host_state2": """
SELECT host AS cache_key, 'jina' AS decision, CAST(5 + max(page_id) % 4 AS INTEGER) AS score
FROM {page_dim} GROUP BY host""",
    "batch_requests": """
SELECT request_id, request_id % 20 AS batch_id FROM {attempts} GROUP BY request_id
UNION ALL
SELECT request_id + 100000000, request_id % 20 FROM {attempts} WHERE request_id % 17 = 0 GROUP BY request_id""",
    "obs": """
SELECT user_id AS page_key, ts, event_id, CASE WHEN event_type = 'error' THEN 0 ELSE 450 + CAST(floor(value) AS BIGINT) END AS text_len,
       CASE WHEN event_id % 23 = 5 THEN 'Seems like you lost connectivity' ELSE 'body' END AS text
FROM {events}""",
    "endpoints": """
SELECT s_suppkey AS endpoint_id, s_nationkey AS grp, (s_suppkey * 37) % 900 - 50 AS delay_ms,
       CASE s_suppkey % 13 WHEN 5 THEN 'DIRECT' WHEN 6 THEN '香港 01' WHEN 8 THEN NULL ELSE s_name END AS name
FROM {supplier}""",
    "uses": "SELECT user_id AS endpoint_id, ts FROM {events} WHERE event_type = 'view'",
    "files": """
SELECT o_orderkey AS file_id, concat('f', o_orderkey, '.pdf') AS filename, CAST(floor(o_totalprice) AS BIGINT) AS file_size,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderdate END AS download_time FROM {orders}""",
}


def _needs(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"{(\w+)}", VIEWS[name])))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in _needs(name)})


def ctes(*names: str) -> str:
    """``WITH`` list holding the named views and all they need, in order."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in BASE or name in done:
            return
        for n in _needs(name):
            add(n)
        done[name] = f"{name} AS ({VIEWS[name].format(**{n: n for n in _needs(name)})}\n)"

    for name in names:
        add(name)
    return "WITH " + ",\n".join(done.values())
