import random
import re

import duckdb
from compare import differences
from conftest import ODD_TEXTS

from crawlspark.llm import license_scan as S
from crawlspark.llm.oracles import ORACLES
from crawlspark.llm.queries import QUERIES

PHRASES = [(p.split(), label) for p, label in S.PHRASES]
COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def slow_base(doc_id, text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    hits = [(i, label) for p, label in PHRASES for i in range(len(words)) if words[i:i + len(p)] == p]
    places = [i for i, _ in hits]
    return (doc_id, len(words), len(hits), min(places, default=None), max(places, default=None),
            ",".join(sorted({label for _, label in hits})))


def key(r):
    return tuple((x is not None, x) for x in r)


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    name = "op12_license_scan"
    assert differences(QUERIES[name](spark, sf_dir), con.sql(ORACLES[name])) is None


def test_base_columns_equal_brute_force(spark, odd, none):
    rng = random.Random(5)
    filler = ["the", "mit", "under", "license", "cc", "by", "nc", "apache", "version", "2", "é"]
    texts = [(k, " ".join(rng.choices(filler, k=rng.randrange(40)) + rng.choice([[], S.PHRASES[k % 3][0].split()]))) for k in range(200)]
    texts += [(500, "CC-BY-NC\ncc by nc cc by nc"), (501, "under THE Mit\tLicense"), (502, "cc by nc " * 5000), (502, None),
              (None, "Apache License, Version 2.0")]
    rows = spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id long, text string, label string, span int").unionByName(
        odd.select("doc_id", "text"), allowMissingColumns=True)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in S.find_licenses(rows).collect()), key=key)
    assert got == sorted((slow_base(*t) for t in texts + ODD_TEXTS), key=key)
    assert S.find_licenses(none).count() == 0


def test_spans_survive_edits(spark):
    notice = dict((label, t) for t, label in S.NOTICES if len(t.split()) > 20)
    apache, isc = notice["apache-2"].split(), notice["isc"].split()
    added = apache[:9] + ["kindly"] + apache[9:18] + apache[19:]   # a word in, a word out
    texts = [(1, "intro words " + " ".join(apache) + " and more"), (2, " ".join(added)), (3, " ".join(apache[:8])),
             (4, " ".join(isc + ["then"] + isc)), (5, " ".join(w[::-1] for w in apache)), (6, "All rights reserved.")]
    got = {r.doc_id: r for r in S.find_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1].labels == "apache-2" and got[1].score == 1.0
    assert ("apache-2", 2, 2 + len(apache)) in [tuple(s) for s in got[1].spans]
    assert got[2].labels == "apache-2" and 0.7 <= got[2].score <= 1.0
    assert [(s.from_word, s.to_word) for s in got[2].spans if s.to_word - s.from_word > 10] == [(0, len(added))]
    assert got[3].labels == "apache-2" and got[3].n_base == 1  # the phrase alone, not the notice
    assert [s.label for s in got[4].spans] == ["isc", "isc"]
    assert got[5].labels == "" and got[5].score == 0 and got[5].spans == []
    assert got[6].labels == "all-rights-reserved" and got[6].base_labels == ""


def test_only_dataframe_functions(odd):
    plan = S.find_licenses(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD.*template", plan)
