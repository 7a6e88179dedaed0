import base64
import json

import pytest
from pyspark.sql import functions as F

from crawlspark.functions.urls import url_template
from crawlspark.operators import races, ranking, requests, routing
from crawlspark.plans.fixtures import view
from crawlspark.rules import DEFAULT_RULES, load_rules, rule_tables, rules_from_dict
from crawlspark.sources import readers, writers

CONFIG = {"spa_domains": ["www.App.io", "x.com"], "spa_root_selectors": ["div[id=\"root\"]", "app-root"], "spa_meta_tags": ["name=\"viewport\""],
          "pdf_detection": {"known_pdf_domains": ["www.Nature.com"], "pdf_path_patterns": ["/viewPDF/", "a/.*\\.pdf"], "auto_learn_threshold": 5},
          "detection_thresholds": {"body_text_threshold": 300, "spa_detection_rules": {"criteria": {"empty_body": {"weight": 50}}}},
          "robot_detection": {"indicators": {"text_indicators": {"english": ["Access Denied", "access denied"]}, "url_indicators": ["bot"]}}}


def test_rules_from_file_and_dict_agree(spark, tmp_path):
    place = tmp_path / "rules.json"
    place.write_text(json.dumps(CONFIG, indent=1))
    a, b = load_rules(spark, str(place)), rules_from_dict(CONFIG)
    assert a == b == load_rules(spark, CONFIG)
    assert a.spa_hosts == ("app.io", "x.com") and a.pdf_hosts == ("nature.com",) and a.pdf_patterns == ("/viewpdf/",)
    assert a.spa_weights["empty_body"] == 50 and a.pdf_learn_threshold == 5 and a.block_terms[("text", "english")] == ("access denied",)


def test_rule_tables(spark):
    t = rule_tables(spark)
    assert t["spa_hosts"].count() == len(DEFAULT_RULES.spa_hosts)
    assert t["block_terms"].count() == sum(map(len, DEFAULT_RULES.block_terms.values()))
    assert t["block_terms"].columns == ["section", "language", "term"]


@pytest.mark.parametrize("codec,header,want", [
    ("utf-8", "text/html; charset=UTF-8", "utf-8"), ("gbk", "text/html; charset=gbk", "gbk"), ("gb18030", None, "gbk"),
    ("big5", 'text/html; charset="big5"', "big5"), ("utf-8", "text/html; charset=no-such", "utf-8"), ("gbk", "text/html; charset=utf-8", "gbk")])
def test_decode_bodies(spark, codec, header, want):
    page = "<p>漢字中文測試</p>" if codec == "big5" else "<p>汉字中文测试</p>"
    df = spark.createDataFrame([(1, bytearray(page.encode(codec)), header)], "id int, body binary, content_type string")
    row = readers.decode_bodies(df).first()
    assert (row.charset, row.html) == (want, page)


def test_decode_by_meta_and_empty(spark):
    page = '<meta charset="gb18030"><p>汉字</p>'
    df = spark.createDataFrame([(1, bytearray(page.encode("gb18030")), None), (2, bytearray(b""), None), (3, None, None), (4, bytearray(b"\xff\xfe\xfa\x81"), None)],
                               "id int, body binary, content_type string")
    got = {r.id: (r.charset, r.html) for r in readers.decode_bodies(df).collect()}
    assert got[1] == ("gb18030", page) and got[2] == ("utf-8", "") and got[3] == (None, None) and got[4][0] is not None


def test_hostile_charset_names_do_not_end_the_job(spark):
    names = ["zip", "hex", "rot13", "base64", "bz2", "", "a b", "utf_8\0", "undefined", "idna", "punycode", "unicode_escape", "x" * 5000]
    rows = [(i, bytearray("é 汉字".encode()), f"text/html; charset={n}") for i, n in enumerate(names)]
    got = readers.decode_bodies(spark.createDataFrame(rows, "id int, body binary, content_type string")).collect()
    assert len(got) == len(names) and all(r.html is not None for r in got)
    assert {r.html for r in got if names[r.id] in ("zip", "hex", "rot13", "base64", "bz2", "a b")} == {"é 汉字"}


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.txt").write_bytes(b"text")
    got = {r.n: (r.length, r.head) for r in readers.read_bodies(spark, str(tmp_path)).select(
        F.element_at(F.split("path", "/"), -1).alias("n"), "length", readers.first_bytes().alias("head")).collect()}
    assert got == {"a.bin": (10, "255044462D312E37"), "b.txt": (4, "74657874")}


def test_packed_bodies(spark, tmp_path):
    (tmp_path / "a").write_bytes(base64.b64encode(b"%PDF\n\xff") + b"\n\n" + base64.b64encode(b"x") + b"\n")
    (tmp_path / "b").write_bytes(b"\n" + base64.b64encode(b"cut"))
    (tmp_path / "c").write_bytes(b"")
    got = readers.read_bodies(spark, str(tmp_path), packed=True).select(F.element_at(F.split("path", "/"), -1).alias("n"), "length", "body", "modified").collect()
    assert sorted((r.n, r.length, bytes(r.body)) for r in got) == [("a", 0, b""), ("a", 1, b"x"), ("a", 6, b"%PDF\n\xff"), ("b", 0, b""), ("b", 3, b"cut")]
    assert all(r.modified is not None for r in got)


def test_results_are_ordered_per_lane(spark, tmp_path):
    n = 5000
    df = spark.range(n).select(F.col("id").alias("pos"), F.when(F.col("id") % 10 == 0, "jina").otherwise("easyget").alias("lane")).repartition(7)
    # Tiny data: keep the range partitions that Spark would merge by size.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_results(df, str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert spark.read.parquet(str(tmp_path / "out")).count() == n
    ranges = []
    for f in sorted((tmp_path / "out" / "lane=easyget").glob("*.parquet")):
        pos = [r.pos for r in spark.read.parquet(str(f)).collect()]
        assert pos == sorted(pos)
        ranges.append((pos[0], pos[-1]))
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_state_versions(spark, tmp_path):
    place = str(tmp_path / "state")
    assert writers.load_state(spark, place) is None
    df = spark.createDataFrame([("a", 1)], "cache_key string, score int")
    assert writers.save_state(df, place) == 0
    newer = writers.load_state(spark, place).withColumn("score", F.lit(2))
    assert writers.save_state(newer, place) == 1
    (tmp_path / "state" / "version=7").mkdir()  # cut short: no success mark
    assert writers.state_versions(spark, place) == [0, 1]
    assert writers.save_state(newer, str(tmp_path / "other")) == 0 and writers.state_versions(spark, place, complete=False) == [0, 1, 7]
    assert writers.load_state(spark, place).first().score == 2 and writers.load_state(spark, place, 0).first().score == 1


def test_requests(spark):
    df = spark.createDataFrame([(1, ["a", " "], "normal", "web"), (2, ["a"], "turbo", "web"), (3, [], "fast", "pdf"), (4, ["b", "c"], None, None), (5, None, "fast", "auto")],
                               "request_id int, urls array<string>, mode string, crawl_type string")
    got = {(r.request_id, r.pos): (r.invalid_reason, r.request_rejected) for r in requests.url_requests(df).collect()}
    assert got == {(1, 0): (None, True), (1, 1): ("blank_url", True), (2, 0): ("bad_mode", True), (3, None): ("empty_urls", True),
                   (4, 0): (None, False), (4, 1): (None, False), (5, None): ("empty_urls", True)}


def test_parent_lookup_takes_the_nearest(spark):
    urls = spark.createDataFrame([(1, "a.b.c.org"), (2, "b.c.org"), (3, "c.org"), (4, "z.net"), (5, "localhost"), (6, None)], "id int, host string")
    state = spark.createDataFrame([("b.c.org", "jina", 1), ("c.org", "pdf", 2), ("org", "easyget", 3), ("localhost", "jina", 1)], "cache_key string, decision string, score int")
    got = {r.id: r.cached_decision for r in routing.cached_route(urls, state).collect()}
    assert got == {1: "jina", 2: "jina", 3: "pdf", 4: None, 5: None, 6: None}


def test_repeated_state_entries_multiply_no_urls(spark):
    state = spark.createDataFrame([("h.org:/a/{id}", "jina", 1), ("h.org:/a/{id}", "pdf", 5), ("h.org", "easyget", 1), ("h.org", "playwright", 3)],
                                  "cache_key string, decision string, score int")
    urls = spark.createDataFrame([(1, "https://h.org/b"), (2, "https://h.org/c")], "page_id int, url string")
    got = {r.page_id: r["mode"] for r in routing.route(urls, state).collect()}
    assert got == {1: "playwright", 2: "playwright"} and routing.route(urls, state).count() == 2
    key = urls.select(url_template("url").alias("t")).first().t
    own = spark.createDataFrame([(f"h.org:{key}", "jina", 1), (f"h.org:{key}", "pdf", 5)], state.schema)
    assert [(r.page_id, r["mode"]) for r in routing.route(urls, own).orderBy("page_id").collect()][0] == (1, "pdf")
    assert routing.route(urls, own).count() == 2


def test_route_order(spark):
    urls = spark.createDataFrame([(1, "http://s.org/x.pdf"), (2, "http://n.org/x.pdf"), (3, "http://github.com/a"), (4, "http://n.org/a"), (5, "http://n.org/b"),
                                  (6, "http://n.org/c"), (7, "http://dead.org/")], "page_id int, url string")
    state = spark.createDataFrame([("s.org", "easyget", 1), ("dead.org", "blocked", 1)], "cache_key string, decision string, score int")
    probes = spark.createDataFrame([(4, True), (5, False)], "page_id int, effective boolean")
    got = {r.page_id: (r["mode"], r.confidence) for r in routing.route(urls, state, probes=probes).collect()}
    assert got == {1: ("easyget", 100), 2: ("pdf", 95), 3: ("playwright", 95), 4: ("easyget", 85), 5: ("playwright", 80), 6: ("race", 0), 7: ("blocked", 100)}


def test_race_policies(spark):
    rows = [(1, 1, "easyget", True, 3.0), (2, 1, "jina", False, 1.0), (3, 1, "playwright", True, 2.0), (4, 2, "easyget", True, 1.0), (5, 2, "jina", True, 1.0), (6, 3, "jina", False, 1.0)]
    df = spark.createDataFrame(rows, "attempt_id int, request_id int, lane string, success boolean, elapsed_s double").select(
        "*", F.lit(200).alias("status_code"), F.lit("u").alias("url"), F.lit("h").alias("host"), F.current_timestamp().alias("ts"))
    assert {r.request_id: r.attempt_id for r in races.race_winner(df).collect()} == {1: 3, 2: 4}
    assert {r.request_id: r.attempt_id for r in races.race_winner(df, "first_finisher").collect()} == {1: 1, 2: 4}
    with pytest.raises(ValueError):
        races.race_winner(df, "best")
    late = df.withColumn("elapsed_s", F.when(F.col("attempt_id") != 3, F.col("elapsed_s")))  # an unknown time never wins
    assert {r.request_id: r.attempt_id for r in races.race_winner(late).collect()} == {1: 1, 2: 4}


def test_pdf_lane_and_missing_values(spark):
    rows = [(1, 1, "pdf", False, 1.0, None, "pdf broken"), (2, 1, "easyget", False, 0.0004, None, None), (3, 2, "pdf", True, 0.5, None, None),
            (4, 2, None, False, None, None, None)]
    df = spark.createDataFrame(rows, "attempt_id int, request_id int, lane string, success boolean, elapsed_s double, markdown string, pdf_error string")
    df = df.select("*", F.lit(200).alias("status_code"), F.lit("u").alias("url"), F.lit("h").alias("host"), F.current_timestamp().alias("ts"),
                   *[F.lit(None).cast("string").alias(c) for c in ("html", "easyget_error", "playwright_error", "jina_error")], F.lit("c").alias("case"))
    lost = races.race_failures(races.with_causes(df)).collect()
    assert [(r.request_id, r.pdf_error) for r in lost] == [(1, "pdf broken")] and lost[0].markdown.endswith(" | PDF: pdf broken")
    table = races.latency_table(df).first()
    assert (table.pdf_n, table.other_n, table.easyget_n, table.jina_n) == (2, 1, 1, 0) and table.easyget_max_ms == 0.4 and table.pdf_avg_ms == 750.0
    done = races.resolved_requests(df)
    assert sorted(tuple(r) for r in done.collect()) == [(1, False, 1.0), (2, True, 0.5)]
    null = done.withColumn("success", F.lit(None).cast("boolean")).withColumn("batch_id", F.lit(1))
    assert requests.batch_code(null).first().code == 1 and {r.outcome for r in requests.outcomes(null).collect()} == {"failed"}


def test_visit_curve_on_one_hot_host(spark, sf_dir):
    a = view(spark, sf_dir, "attempts").withColumn("host", F.when(F.col("attempt_id") % 3 > 0, "hot.org").otherwise(F.col("host")))
    got = {r.visit: (r.visits, r.avg_ms) for r in races.visit_curve(a).collect()}
    counts = [r["count"] for r in a.groupBy("host").count().collect()]
    assert got["1"][0] == len(counts) and got["5+"][0] == sum(max(0, c - 4) for c in counts)


def test_candidates(spark):
    e = spark.createDataFrame([(1, "g", 100), (2, "g", 300), (3, "g", -1), (4, "g", 200)], "endpoint_id int, grp string, delay_ms int")
    u = spark.createDataFrame([(1, 1000), (2, 700)], "endpoint_id int, last_used long")
    fit = ranking.eligible_endpoints(e, current=4)
    got = {r.endpoint_id: (r.score, r["rank"]) for r in ranking.candidate_scores(fit, u, 1150, k=2).collect()}
    assert got == {1: (0.85, 1), 2: (0.3, 2)}
    named = e.withColumn("name", F.when(F.col("endpoint_id") == 1, "DIRECT"))
    assert {r.endpoint_id for r in ranking.eligible_endpoints(named).collect()} == {2, 4}  # a missing name is kept
    assert ranking.candidate_scores(fit, u, 1150, k=2).filter("picked").count() == 1


def test_retention_of_text_times(spark):
    df = spark.createDataFrame([("a", "2024-01-01T10:00:00", 5), ("b", "2024-01-02T10:00:00", 6), ("c", "soon", 7), ("d", None, 8)], "f string, download_time string, file_size long")
    got = {r.f: (r.fate, r.removed) for r in ranking.retention_split(df, F.lit("2024-01-02 12:00:00").cast("timestamp")).collect()}
    assert got == {"a": ("expire", True), "b": ("keep", False), "c": ("invalid", True), "d": ("invalid", True)}
