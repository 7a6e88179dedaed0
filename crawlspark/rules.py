"""Rule dictionaries (SRC3): defaults, JSON loading, dimension tables.

A rule set is bounded configuration (at most a few hundred entries), so operators fold it into
literals; :func:`rule_tables` gives the same content as small tables for join-style use.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANES = ("easyget", "jina", "playwright", "pdf")  # tie order in a race
MODES = ("normal", "fast", "playwright", "jina", "no_jina")
CRAWL_TYPES = ("pdf", "web", "auto")

# ---- Fixed values: results depend on these exact words, hosts and patterns. ----

SPA_HOSTS = (
    "cnblogs.com", "edx.org", "mailchimp.com", "gitee.com", "uber.com", "weibo.com", "coursera.org",
    "hubspot.com", "clickup.com", "replit.com", "etsy.com", "x.com", "asana.com", "github.com",
    "wordpress.com", "doordash.com", "codepen.io", "grubhub.com", "codesandbox.io", "taobao.com",
    "coinbase.com", "youtube.com", "linkedin.com", "monday.com", "substack.com", "alibaba.com",
    "binance.com", "tradingview.com", "facebook.com", "tmall.com", "spotify.com", "heroku.com",
    "khanacademy.org", "wix.com", "zhihu.com", "iqiyi.com", "instagram.com", "lyft.com",
    "bitbucket.org", "bloomberg.com", "tiktok.com", "figma.com", "netflix.com", "tencent.com",
    "miro.com", "airbnb.com", "segmentfault.com", "paypal.com", "twitch.tv", "duolingo.com", "jd.com",
    "intercom.com", "webull.com", "udemy.com", "netlify.app", "zendesk.com", "discord.com",
    "vercel.app", "trello.com", "squarespace.com", "canva.com", "gitlab.com", "medium.com",
    "youku.com", "csdn.net", "quizlet.com", "stripe.com", "postmates.com", "salesforce.com",
    "coding.net", "bilibili.com", "jianshu.com", "ghost.org", "amazon.com", "douban.com",
    "twitter.com", "stackblitz.com", "shopify.com", "slack.com", "robinhood.com", "oschina.net",
    "airtable.com", "instacart.com", "notion.so", "juejin.cn", "reddit.com", "pinduoduo.com",
    "ebay.com",
)

PDF_HOSTS = (
    "researchgate.net", "jmlr.org", "proceedings.aaai.org", "www.nature.com", "openreview.net",
    "proceedings.mlr.press", "www.ijcai.org", "proceedings.icml.cc", "semanticscholar.org",
    "ieeexplore.ieee.org", "scholar.google.com", "link.springer.com", "proceedings.neurips.cc",
    "academia.edu", "biorxiv.org", "dl.acm.org", "aclanthology.org", "medrxiv.org",
)

PDF_PATTERNS = (
    "/pdf/", "/content/pdf/", "/paper_files/paper/", "/proceedings/", "/article/pdf/",
    "/download/pdf/", "/viewPDF/", "/getPDF/", "pdf?", "download=pdf", "format=pdf", "type=pdf",
    "arxiv.org/pdf/",
)

PDF_QUERY_INDICATORS = ("pdf", "download", "attachment")

PDF_VIEWER_SITES = (
    "arxiv.org/pdf/", "dl.acm.org/doi/pdf/", "proceedings.mlr.press", "biorxiv.org/content",
    "medrxiv.org/content", "openreview.net", "aclanthology.org", "ieeexplore.ieee.org",
    "link.springer.com", "www.nature.com/articles",
)

PDF_HEADER_SITES = (
    "arxiv.org/pdf/", "dl.acm.org/doi/pdf/", "proceedings.mlr.press", "biorxiv.org/content",
    "medrxiv.org/content",
)

_V = r"(?:[.-]?\d+)?(?:\.min)?\.js"  # optional version, optional ".min", ".js"

SPA_SCRIPT_PATTERNS = (
    r"react[.-]?(?:dom)?" + _V, r"react[.-]?(?:router)?" + _V, r"react[.-]?(?:app|bundle|main)" + _V,
    r"vue" + _V, r"vue[.-]?(?:router|vuex)?" + _V, r"vue[.-]?(?:app|bundle|main)" + _V,
    r"angular" + _V, r"angular[.-]?(?:core|common|router)?" + _V,
    r"@angular[/\\](?:core|common|router|platform-browser)",
    r"svelte" + _V, r"next" + _V, r"nuxt" + _V, r"gatsby" + _V, r"ember" + _V, r"backbone" + _V,
    r"knockout" + _V, r"webpack[.-]?(?:runtime|bundle|chunk)?" + _V, r"bundle" + _V, r"chunk" + _V,
    r"vendor" + _V, r"runtime" + _V, r"main" + _V, r"app" + _V, r"require" + _V, r"systemjs" + _V,
    r"amd" + _V, r"esm?[.-]?(?:module)?" + _V, r"module" + _V, r"es6?" + _V,
    r"spa[.-]?(?:app|bundle|main)?" + _V, r"single[.-]?page[.-]?(?:app)?" + _V, r"redux" + _V,
    r"mobx" + _V, r"vuex" + _V, r"pinia" + _V, r"router" + _V, r"history" + _V,
    r"page(?:[.-]?js)?" + _V, r"tailwind(?:[.-]?\d+)?(?:\.min)?\.css",
    r"styled[.-]?components" + _V, r"emotion" + _V,
)

SPA_ROOTS = (
    'div[id="root"]', 'div[id="app"]', 'div[id="main"]', 'div[id="content"]', 'div[class*="app"]',
    'div[class*="root"]', 'div[class*="container"]', 'main[id="app"]', 'section[id="app"]',
    'article[id="app"]', "app-root", "ng-app", "vue-app", "react-root", "spa-container",
    "single-page-app",
)

SPA_METAS = (
    'name="viewport"', 'name="description"', 'property="og:', 'name="twitter:', 'name="generator"',
    'name="application-name"', 'name="mobile-web-app-capable"', 'name="apple-mobile-web-app-capable"',
    'name="theme-color"', 'name="msapplication-',
)

SPA_WEIGHTS = {
    "empty_body": 40, "high_script_count": 35, "spa_framework_scripts": 30,
    "spa_root_container": 25, "meta_indicators": 10,
}

CLOUDFLARE_TERMS = ("cloudflare", "ddos protection", "just a moment", "attention required")
REQUIRE_JS_TERMS = (
    "please enable javascript", "javascript is required", "请启用javascript", "需要启用javascript",
)
BLOCK_TERMS = (
    "captcha", "recaptcha", "hcaptcha", "turnstile", "robot check", "are you a robot", "are you human",
    "human verification", "verify you are human", "security check", "security verification",
    "prove you are human", "cf-chl", "challenge-platform", "access denied", "too many requests",
    "rate limit", "temporarily unavailable", "request blocked", "request was blocked", "验证码",
    "人机验证", "安全验证", "验证您是人类", "您的访问过于频繁", "访问被拒绝", "请求过于频繁",
)
TIMEOUT_TERMS = (
    "navigation timeout", "timeout exceeded", "timed out", "net::err_timed_out",
    "err_connection_timed_out", "timeouterror", "request timed out", "请求超时", "连接超时", "操作超时",
)
TOO_SHORT_TERMS = (
    "too_short", "too short", "text_too_short", "cleaned_text_too_short", "plain_text_too_short",
    "文本太短", "内容过短", "部分加载",
)
PROBE_INDICATORS = (
    "403 Forbidden", "404 Not Found", "503 Service Unavailable", "Access Denied", "Blocked", "Captcha",
    "Human Verification", "Please enable JavaScript", "JavaScript is required",
    "This site is protected", "CloudFlare", "DDoS protection", "验证码", "人机验证", "访问被拒绝",
    "页面不存在", "服务不可用", "需要启用JavaScript", "请启用JavaScript",
)
LANE_CLOUDFLARE_TERMS = ("cloudflare", "just a moment", "are you a robot", "attention required")
LANE_VERIFY_TERMS = ("captcha", "robot check", "human verification", "are you human")
CONNECTIVITY_PHRASES = (
    "Seems like you lost connectivity", "We'll keep retrying", "似乎失去了连接", "我们会继续重试",
)
SPECIAL_ENDPOINTS = ("DIRECT", "REJECT", "自动选择", "故障转移")

BLOCK_TEXT_EN = (
    "403 Forbidden", "404 Not Found", "503 Service Unavailable", "Access Denied", "Blocked", "Captcha",
    "Human Verification", "Please enable JavaScript", "JavaScript is required",
    "This site is protected", "CloudFlare", "DDoS protection", "Verify you are not a robot",
    "Please verify you're not a robot", "reCAPTCHA", "I'm not a robot", "Security check",
    "Bot detection", "Rate limited", "Too many requests", "Please wait", "Checking your browser",
    "PerimeterX", "DataDome", "Akamai", "Imperva", "Bot protection", "Anti-bot",
    "Security verification", "Human verification required", "Please complete the security check",
    "Your access to this site has been limited",
    "We've detected unusual traffic from your computer network",
    "Please complete the CAPTCHA below", "Click the checkbox to prove you're human",
    "Select all images that contain", "Type the characters you see in the image",
    "Enter the code shown in the image", "Please solve this puzzle to continue", "Security challenge",
    "Access verification", "Browser verification", "Device verification", "IP verification",
    "Location verification", "Traffic analysis", "Behavioral analysis", "Fingerprint verification",
    "Device fingerprinting", "Browser fingerprinting", "Canvas fingerprinting",
    "WebGL fingerprinting", "Audio fingerprinting", "Font fingerprinting", "Screen fingerprinting",
    "Time zone fingerprinting", "Language fingerprinting", "Plugin fingerprinting",
    "Hardware fingerprinting", "Please complete the following to verify you are human.",
    "Before continuing, xxx needs to check your connection security.",
)
BLOCK_TEXT_ZH = (
    "验证码", "人机验证", "访问被拒绝", "页面不存在", "服务不可用", "需要启用JavaScript", "请启用JavaScript",
    "安全检查", "机器人检测", "请求过于频繁", "请稍候", "正在检查您的浏览器", "防护验证", "安全验证", "访问验证",
    "浏览器验证", "设备验证", "IP验证", "位置验证", "流量分析", "行为分析", "指纹验证", "设备指纹", "浏览器指纹",
    "画布指纹", "WebGL指纹", "音频指纹", "字体指纹", "屏幕指纹", "时区指纹", "语言指纹", "插件指纹", "硬件指纹",
    "防护系统", "反机器人", "安全挑战", "访问限制", "流量限制", "请求限制", "频率限制", "时间限制", "地区限制",
    "IP限制", "设备限制", "浏览器限制", "网络限制", "请完成以下操作，验证您是真人。",
    "继续之前，xxx需要先检查您的连接的安全性。",
)
BLOCK_TITLE_EN = (
    "Access Denied", "Blocked", "Captcha", "Security Check", "Human Verification", "Bot Detection",
    "Rate Limited", "Too Many Requests", "Please Wait", "Checking Browser", "PerimeterX", "DataDome",
    "CloudFlare", "Akamai", "Imperva", "Bot Protection", "Anti-Bot", "Security", "Verification",
    "Challenge", "Protection", "Block", "Limit", "Restrict", "Deny", "Forbidden",
)
BLOCK_TITLE_ZH = (
    "访问被拒绝", "被阻止", "验证码", "安全检查", "人机验证", "机器人检测", "请求过于频繁", "请稍候",
    "正在检查浏览器", "防护系统", "反机器人", "安全", "验证", "挑战", "防护", "阻止", "限制", "拒绝", "禁止",
)
BLOCK_URL = (
    "captcha", "verify", "check", "blocked", "403", "503", "security", "challenge", "protection", "bot",
    "anti", "human", "verification", "access", "denied", "forbidden", "rate", "limit", "restrict",
    "block", "fingerprint", "canvas", "webgl", "audio", "font", "screen", "timezone", "language",
    "plugin", "hardware",
)
BLOCK_SERVICES = (
    "cloudflare", "perimeterx", "datadome", "akamai", "imperva", "f5", "barracuda", "paloalto",
    "fortinet", "checkpoint", "cisco", "juniper", "sonicwall", "watchguard", "sophos", "kaspersky",
    "mcafee", "symantec", "trendmicro", "eset", "bitdefender", "avast", "avg", "malwarebytes", "norton",
    "webroot", "comodo", "panda", "bullguard", "emsisoft",
)
SUSPICIOUS_STATUS = (403, 429, 503, 509)
LOW_CONTENT_CHARS = 100

# (host suffix, forced scheme, host that replaces the bare suffix)
ENTRY_REWRITES = (("zhihu.com", "https", "www.zhihu.com"),)

# ---- End of fixed values. ----


def normalise_host(host: str) -> str:
    host = host.strip().lower()
    return host[4:] if host.startswith("www.") else host


# Selectors of block pages. Those on an element's text are left out; the text section covers them.
BLOCK_SELECTORS = (
    'iframe[src*="recaptcha"]', ".g-recaptcha", '[data-callback*="recaptcha"]', ".captcha", "#captcha",
    ".security-check", ".human-verification", ".bot-detection", ".access-denied", ".blocked", ".rate-limited",
    ".too-many-requests", ".please-wait", ".checking-browser", ".perimeterx", ".datadome", ".cloudflare", ".akamai",
    ".imperva", ".bot-protection", ".anti-bot", ".security-verification", ".device-verification",
    ".ip-verification", ".location-verification", ".traffic-analysis", ".behavioral-analysis",
    ".fingerprint-verification", ".device-fingerprinting", ".browser-fingerprinting", ".canvas-fingerprinting",
    ".webgl-fingerprinting", ".audio-fingerprinting", ".font-fingerprinting", ".screen-fingerprinting",
    ".timezone-fingerprinting", ".language-fingerprinting", ".plugin-fingerprinting", ".hardware-fingerprinting",
)

SELECTOR = re.compile(r'(\w+)\[(\w+)(\*?)="([^"]*)"\]')


def _attribute_regex(attr: str, part: str, value: str) -> str:
    value = re.escape(value.lower())
    body = f"[^\"']*{value}" if part else f"{value}[\"']"
    return f"\\b{attr}\\s*=\\s*[\"']{body}"


def selector_regex(selector: str) -> str:
    """``div[id="root"]`` -> regex on the opening tag; a bare token stays a literal."""
    m = SELECTOR.fullmatch(selector)
    if not m:
        return re.escape(selector.lower())
    return f"<{m[1]}\\b[^>]*{_attribute_regex(*m.groups()[1:])}"


def selector_parts(selector: str) -> tuple[str, str, str, str, str]:
    """``tag.class``, ``#id`` or ``tag[attr*="part"]`` as (kind, tag, attribute, value, match); tag may be empty."""
    m = re.fullmatch(r"""(\w*)(?:\.([\w-]+)|#([\w-]+)|\[([\w-]+)(\*?)=["']([^"']*)["']\])""", selector.strip())
    if not m:
        raise ValueError(f"not a simple selector: {selector}")
    tag, cls, ident, attr, part, value = m.groups()
    if cls:
        return "class", tag, "class", cls.lower(), "word"
    if ident:
        return "id", tag, "id", ident.lower(), "whole"
    return "attr", tag, attr.lower(), value.lower(), "part" if part else "whole"


def _unique(items) -> tuple:
    return tuple(dict.fromkeys(items))


def _default_block_terms() -> dict:
    return {
        ("text", "english"): _unique(t.lower() for t in BLOCK_TEXT_EN),
        ("text", "chinese"): _unique(t.lower() for t in BLOCK_TEXT_ZH),
        ("title", "english"): _unique(t.lower() for t in BLOCK_TITLE_EN),
        ("title", "chinese"): _unique(t.lower() for t in BLOCK_TITLE_ZH),
        ("url", "any"): _unique(BLOCK_URL),
        ("service", "any"): _unique(BLOCK_SERVICES),
    }


@dataclass(frozen=True)
class Rules:
    """Normalised rule set: hosts without ``www.`` (D10), lower-case patterns."""

    spa_hosts: tuple = SPA_HOSTS
    pdf_hosts: tuple = tuple(normalise_host(h) for h in PDF_HOSTS)
    pdf_patterns: tuple = tuple(p.lower() for p in PDF_PATTERNS)
    pdf_query_indicators: tuple = PDF_QUERY_INDICATORS
    spa_patterns: tuple = SPA_SCRIPT_PATTERNS
    spa_roots: tuple = SPA_ROOTS
    spa_metas: tuple = SPA_METAS
    spa_weights: dict = field(default_factory=lambda: dict(SPA_WEIGHTS))
    block_terms: dict = field(default_factory=_default_block_terms)
    block_selectors: tuple = BLOCK_SELECTORS
    body_text_threshold: int = 500
    script_count_threshold: int = 10
    min_criteria_match: int = 2
    pdf_learn_threshold: int = 3
    max_state_size: int = 10000

    @property
    def spa_root_words(self) -> tuple:
        return tuple(s.lower() for s in self.spa_roots if not SELECTOR.fullmatch(s))

    @property
    def spa_root_tags(self) -> str:
        """All tag selectors as one regex that starts with ``<``, so that most characters fail at once."""
        tags: dict[str, list] = {}
        for m in filter(None, map(SELECTOR.fullmatch, self.spa_roots)):
            tags.setdefault(m[1], []).append(_attribute_regex(*m.groups()[1:]))
        return "<(?:" + "|".join(f"{t}\\b[^>]*(?:{'|'.join(a)})" for t, a in tags.items()) + ")" if tags else ""


DEFAULT_RULES = Rules()


def rules_from_dict(config: dict) -> Rules:
    """Build a rule set from a parsed configuration; absent sections stay empty."""
    pdf = config.get("pdf_detection") or {}
    limits = config.get("detection_thresholds") or {}
    spa = limits.get("spa_detection_rules") or {}
    weights = {k: (v or {}).get("weight", SPA_WEIGHTS[k]) for k, v in (spa.get("criteria") or {}).items()
               if k in SPA_WEIGHTS}
    robot = (config.get("robot_detection") or {})
    marks = robot.get("indicators") or {}
    terms: dict = {}
    for section, key in (("text", "text_indicators"), ("title", "title_indicators")):
        for language, words in (marks.get(key) or {}).items():
            terms[(section, language)] = _unique(w.lower() for w in words or ())
    if marks.get("url_indicators"):
        terms[("url", "any")] = _unique(w.lower() for w in marks["url_indicators"])
    services = (robot.get("anti_bot_services") or {}).get("detection_patterns")
    if services:
        terms[("service", "any")] = _unique(w.lower() for w in services)
    return replace(
        DEFAULT_RULES,
        spa_hosts=_unique(normalise_host(h) for h in config.get("spa_domains") or ()),
        spa_patterns=tuple(config.get("spa_framework_patterns") or ()),
        spa_roots=tuple(config.get("spa_root_selectors") or ()),
        spa_metas=tuple(config.get("spa_meta_tags") or ()),
        spa_weights={**SPA_WEIGHTS, **weights},
        pdf_hosts=_unique(normalise_host(h) for h in pdf.get("known_pdf_domains") or ()),
        # A pattern with ".*" was meant as a regex but is compared as a literal: dropped.
        pdf_patterns=_unique(p.lower() for p in pdf.get("pdf_path_patterns") or () if ".*" not in p),
        pdf_query_indicators=tuple(pdf.get("pdf_query_indicators") or ()),
        block_terms=terms,
        block_selectors=_unique(x for x in marks.get("css_selectors") or () if ":" not in x),
        body_text_threshold=int(limits.get("body_text_threshold") or 500),
        script_count_threshold=int(limits.get("script_count_threshold") or 10),
        min_criteria_match=int(spa.get("min_criteria_match") or 2),
        pdf_learn_threshold=int(pdf.get("auto_learn_threshold") or 3),
        max_state_size=int(config.get("max_cache_size") or 10000),
    )


def load_rules(spark: SparkSession, source: str | dict) -> Rules:
    """SRC3: rules from a dict, or from one JSON document at ``source``."""
    if isinstance(source, dict):
        return rules_from_dict(source)
    row = spark.read.json(source, multiLine=True).first()
    return rules_from_dict(row.asDict(recursive=True) if row else {})


def rule_tables(spark: SparkSession, rules: Rules = DEFAULT_RULES) -> dict[str, DataFrame]:
    """SRC3: the same rules as dimension tables. They are literal relations, so Catalyst knows how small they are
    and broadcasts them by its own size check."""
    def one(name: str, values) -> DataFrame:
        items = F.array(*[F.lit(v) for v in values]).cast("array<string>")
        return spark.sql("SELECT 1 AS one").select(F.explode(items).alias(name))

    terms = [F.struct(F.lit(s).alias("section"), F.lit(lang).alias("language"), F.lit(t).alias("term"))
             for (s, lang), words in rules.block_terms.items() for t in words]
    shape = "array<struct<section:string,language:string,term:string>>"
    return {
        "spa_hosts": one("host", rules.spa_hosts),
        "pdf_hosts": one("host", rules.pdf_hosts),
        "pdf_patterns": one("pattern", rules.pdf_patterns),
        "spa_patterns": one("regex", rules.spa_patterns),
        "spa_roots": one("regex", [selector_regex(s) for s in rules.spa_roots]),
        "spa_metas": one("marker", rules.spa_metas),
        "block_terms": spark.sql("SELECT 1 AS one").select(F.inline(F.array(*terms).cast(shape))),
    }
