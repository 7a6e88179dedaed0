"""Route lookup per URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import exploded
from ..functions.urls import host_variants, is_pdf_url, is_spa_host, norm_host, url_template
from ..rules import DEFAULT_RULES, Rules


def cached_route(urls: DataFrame, host_state: DataFrame, host: str = "host", hot: int = 0) -> DataFrame:
    """Decision learned for the host or its nearest parent.

    The lookup runs on distinct hosts. Neither side is hinted: Spark broadcasts the state, or the found
    decisions, only while their measured size allows it, and splits skewed hosts otherwise. With ``hot`` the URLs are
    counted by host first, and those of the ``hot`` most frequent hosts are answered from a map of literals where they
    are read; only the others are joined.
    """
    nearest = nearest_entries(urls.select(F.col(host).alias("_host")).distinct(), host_state)
    columns = [F.col(c) for c in urls.columns]

    def answered(rows: DataFrame) -> DataFrame:
        return rows.select(*columns, F.col("_hit.cache_key").alias("matched_key"), F.col("_hit.decision").alias("cached_decision"),
                           F.col("_hit.score").alias("cached_score"))

    names = frequent_hosts(urls, hot, host) if hot else []
    if not names:
        return answered(urls.join(nearest, urls[host] == nearest["_host"], "left"))
    known = nearest_entries(urls.sparkSession.createDataFrame([(n,) for n in names], "_host string"), host_state)
    entries = {r._host: r._hit for r in known.collect()}  # at most ``hot`` rows
    entry = host_state.select("cache_key", "decision", "score").schema

    def literal(hit) -> Column:
        return F.struct(*[F.lit(hit[f.name] if hit else None).cast(f.dataType).alias(f.name) for f in entry.fields])

    table = F.create_map(*[x for n in names for x in (F.lit(n), literal(entries.get(n)))])
    is_hot = F.coalesce(F.col(host).isin(names), F.lit(False))
    rest = urls.filter(~is_hot)
    return answered(urls.filter(is_hot).withColumn("_hit", table[F.col(host)])).unionByName(
        answered(rest.join(nearest, rest[host] == nearest["_host"], "left")))


def nearest_entries(hosts: DataFrame, host_state: DataFrame) -> DataFrame:
    """_host and the entry (``_hit``) of the host itself or its nearest parent that has one."""
    tried = exploded(hosts, host_variants("_host"), "_depth", "cache_key", "_host")
    hit = tried.join(host_state.select("cache_key", "decision", "score"), "cache_key")
    return hit.groupBy("_host").agg(F.min_by(
        F.struct("cache_key", "decision", "score"), F.struct("_depth", -F.col("score"), "decision")).alias("_hit"))


def frequent_hosts(urls: DataFrame, most: int, host: str = "host", share: float = 0.001) -> list[str]:
    """The most frequent hosts, at most ``most``, each with at least ``share`` of all URLs."""
    counts = urls.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).count()
    total = counts.agg(F.sum("count").alias("n")).first().n or 0
    return [r.host for r in counts.filter(F.col("count") >= max(1, share * total)).orderBy(F.desc("count"), "host").limit(most).collect()]


GRAM = 3  # characters of the grams that URLs and patterns share


def containing(urls: DataFrame, patterns: DataFrame, key: str = "page_id", url: str = "url", pattern: str = "pattern") -> DataFrame:
    """URL8 for any number of loaded patterns: ``key`` and ``pattern`` for every pattern that stands in a URL, case aside.

    A pattern stands in a URL only if its rarest gram does, so the URLs' grams are joined with one gram of each pattern,
    the one that the fewest URLs hold, and ``contains`` verifies. A pattern with a gram that no URL holds drops out before
    the join. Shorter patterns are a gram of their own length; an empty one stands in no URL.
    """
    rows = urls.select(key, F.lower(url).alias("_url"))
    names = patterns.select(F.lower(pattern).alias("_pattern")).filter("_pattern <> ''").distinct()

    def grams(c: str, size) -> Column:
        ends = F.length(c) - size + 1
        cut = F.transform(F.sequence(F.lit(1), ends), lambda i: F.substring(F.col(c), i, F.lit(size) if isinstance(size, int) else size))
        return F.coalesce(F.array_distinct(F.when(ends > 0, cut)), F.array().cast("array<string>"))

    own = names.select("_pattern", F.explode(grams("_pattern", F.least(F.length("_pattern"), F.lit(GRAM)))).alias("_gram"))
    parts = F.array_union(grams("_url", GRAM), F.array_union(grams("_url", 2), grams("_url", 1)))
    held = rows.select(key, "_url", F.explode(parts).alias("_gram"))
    wanted = held.select("_gram").join(own.select("_gram").distinct(), "_gram", "left_semi")
    counts = wanted.groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = (own.join(counts, "_gram", "left").groupBy("_pattern")
              .agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"), F.min(F.coalesce("_n", F.lit(0))).alias("_least"))
              .filter("_least > 0").select("_pattern", "_gram"))
    return held.join(rarest, "_gram").filter(F.col("_url").contains(F.col("_pattern"))).select(key, F.col("_pattern").alias("pattern"))


def learned_pdf(urls: DataFrame, hosts: DataFrame | None, patterns: DataFrame | None, key: str = "page_id") -> DataFrame:
    """Keys of the URLs that learned PDF hosts (L3, ``host``) or learned paths (L4, ``pattern``) make PDFs.

    Hosts are looked up by their variants. A pattern starts and ends with a slash, so it occurs in a URL just if it is
    a run of whole segments of it: both become equi-joins, whose learned side may be of any size.
    """
    found = []
    if hosts is not None:
        named = urls.select(key, norm_host("url").alias("_host"))
        tried = exploded(named.select("_host").distinct(), host_variants("_host"), "_depth", "host", "_host")
        hit = tried.join(hosts.select("host").distinct(), "host", "left_semi").select("_host").distinct()
        found.append(named.join(hit, "_host", "left_semi").select(key))
    if patterns is not None:
        inner = F.slice(F.split(F.lower("url"), "/"), 2, F.greatest(F.size(F.split("url", "/")) - 2, F.lit(0)))
        ends = F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda j: F.when(F.get("_parts", j - 1).contains("pdf"), j))
        runs = F.flatten(F.transform(F.filter(ends, lambda j: j.isNotNull()), lambda j: F.transform(
            F.sequence(F.lit(1), j), lambda i: F.concat(F.lit("/"), F.array_join(F.slice("_parts", i, j - i + 1), "/"), F.lit("/")))))
        rows = urls.select(key, inner.alias("_parts")).filter(F.size("_parts") > 0)
        tried = exploded(rows, runs, "_n", "pattern", key)
        found.append(tried.join(patterns.select(F.lower("pattern").alias("pattern")).distinct(), "pattern", "left_semi").select(key))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def route(urls: DataFrame, host_state: DataFrame, rules: Rules = DEFAULT_RULES, probes: DataFrame | None = None,
          key: str = "page_id", pdf_hosts: DataFrame | None = None, pdf_patterns: DataFrame | None = None) -> DataFrame:
    """R2: recommended mode per URL - learned state, PDF rule, SPA host, probe, else a race.

    ``probes`` holds one row per ``key`` with a boolean ``effective``; its ``text_length``, ``status_code``,
    ``elapsed_s`` and ``failure_reasons`` go into the reason where they are given. ``pdf_hosts`` and ``pdf_patterns`` are learned
    ones (L3, L4) beside those of the rules. An entry for the URL's own ``host:template`` (L8) comes before its host's; of
    entries with the same key the one of the highest score counts.
    """
    # Rules are judged before the joins, on the URL alone; page bodies never enter a shuffle here.
    judged = urls.select(*[c for c in urls.columns if c not in ("host", "html")],
                         norm_host("url").alias("host"), is_pdf_url("url", rules).alias("_pdf"),
                         is_spa_host("url", rules).alias("_spa"))
    if pdf_hosts is not None or pdf_patterns is not None:
        more = learned_pdf(urls, pdf_hosts, pdf_patterns, key).withColumn("_learned", F.lit(True))
        judged = judged.join(more, key, "left").withColumn("_pdf", F.col("_pdf") | F.col("_learned").isNotNull()).drop("_learned")
    looked = cached_route(judged, host_state)
    own = host_state.filter(F.col("cache_key").contains(":")).groupBy(F.col("cache_key").alias("_tkey")).agg(
        F.max_by("decision", F.struct("score", "decision")).alias("_tdecision"))
    looked = (looked.withColumn("_tkey", F.concat("host", F.lit(":"), url_template("url"))).join(own, "_tkey", "left")
              .withColumn("matched_key", F.when(F.col("_tdecision").isNotNull(), F.col("_tkey")).otherwise(F.col("matched_key")))
              .withColumn("cached_decision", F.coalesce("_tdecision", "cached_decision")))
    if probes is not None:
        looked = looked.join(probes.select(key, F.col("effective").alias("_probe"), _probe_reason(probes).alias("_why")), key, "left")
    else:
        looked = looked.withColumn("_probe", F.lit(None).cast("boolean")).withColumn("_why", F.lit(None).cast("string"))
    hit = F.col("cached_decision").isNotNull()
    verdict = (
        F.when(hit, F.struct(F.col("cached_decision").alias("mode"),
                             F.when(F.col("cached_decision") == "pdf", "cache_hit_pdf").otherwise("cache_hit").alias("method"),
                             F.lit(100).alias("confidence"), F.concat(F.lit("缓存决策: "), F.col("matched_key")).alias("reason")))
        .when(F.col("_pdf"), _verdict("pdf", "pdf_url_pattern", 95, "URL模式匹配为PDF文件"))
        .when(F.col("_spa"), _verdict("playwright", "domain_blacklist", 95, "域名在SPA黑名单中"))
        .when(F.col("_probe"), _verdict("easyget", "easyget_test_success", 85, F.col("_why")))
        .when(~F.col("_probe"), _verdict("playwright", "easyget_test_failed", 80, F.col("_why")))
        .otherwise(_verdict("race", "no_probe", 0, "")))
    keep = [c for c in looked.columns if not c.startswith("_") and c not in ("matched_key", "cached_decision", "cached_score")]
    return looked.select(*keep, verdict.alias("v"), hit.alias("cache_hit")).select(*keep, "v.*", "cache_hit")


def _verdict(mode: str, method: str, confidence: int, reason):
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(mode).alias("mode"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"),
                    reason.alias("reason"))


def _probe_reason(probes: DataFrame):
    """What a probe found, in words that are fixed values; figures where the probe has them."""
    have = set(probes.columns)
    figures = [F.concat(F.lit(before), text(F.col(name)), F.lit(after)) for name, before, after, text in (
        ("text_length", "文字", "字符", lambda c: c.cast("string")), ("status_code", "状态", "", lambda c: c.cast("string")),
        ("elapsed_s", "耗时", "s", lambda c: F.format_string("%.1f", c))) if name in have]
    good = F.concat(F.lit("EasyGet有效("), F.concat_ws("，", *figures), F.lit(")")) if figures else F.lit("EasyGet有效")
    bad = F.lit("EasyGet失败")
    if "failure_reasons" in have:
        bad = F.concat(F.lit("EasyGet失败: "), F.array_join("failure_reasons", ", "))
    return F.when(F.col("effective"), good).otherwise(bad)


def route_accuracy(routes: DataFrame, winners: DataFrame, key: str = "request_id") -> DataFrame:
    """Predicted mode x winning lane with counts, share of each predicted row, and overall accuracy."""
    from pyspark.sql import Window

    pairs = (routes.select(key, F.col("mode").alias("predicted")).join(winners.select(key, F.col("lane").alias("actual")), key)
             .groupBy("predicted", "actual").agg(F.count("*").alias("n")))
    # Windows run over the few rows of the counted matrix only.
    whole = Window.partitionBy()
    right = F.sum(F.when(F.col("predicted") == F.col("actual"), F.col("n")).otherwise(0)).over(whole)
    return pairs.select("predicted", "actual", "n",
                        F.round(F.col("n") / F.sum("n").over(Window.partitionBy("predicted")), 6).alias("precision"),
                        F.round(right / F.sum("n").over(whole), 6).alias("accuracy"))
