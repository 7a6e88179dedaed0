"""The pipeline and the registered queries against brute-force versions and SQL twins."""

import os
import sys

import duckdb
import pytest
from compare import differences

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline as C  # noqa: E402
import test_byte_bpe  # noqa: E402
from test_simhash import slow_components, slow_fingerprint  # noqa: E402

from crawlspark.llm import decontamination as D  # noqa: E402
from crawlspark.llm import secret_scan as S  # noqa: E402
from crawlspark.llm.oracles import ORACLES  # noqa: E402
from crawlspark.llm.queries import QUERIES  # noqa: E402


def test_pipeline_equals_brute_force(spark, sf_dir, docs):
    toxic = {r.doc_id for r in QUERIES["op7_toxicity"](spark, sf_dir).filter("predicted = 1").collect()}
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect() if r.doc_id not in toxic}
    classes = slow_components({(i, 0): slow_fingerprint(t) for i, t in rows.items()})
    rows = {i: t for i, t in rows.items() if classes[i, 0] == i}
    items = [D.shingles_of(D.words_of(r.text.encode())) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = {i: t for i, t in rows.items()
            if not any(10 * len(x & D.shingles_of(D.words_of(t.encode()))) >= 8 * len(x) for x in items)}
    scan = S.scanner()
    want = {}
    for i, text in rows.items():
        data, at, out = text.encode(), 0, []
        for a, b, k in scan([data])[0]:
            if a >= at:
                out += [data[at:a], b"[" + S.RULES[k].kind.encode() + b"]"]
            at = max(at, b)
        want[i] = test_byte_bpe.want(b"".join([*out, data[at:]]).decode())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in C.run(spark, sf_dir).collect()}
    assert got == want


def test_stages_return_the_columns_of_documents(spark, sf_dir, odd):
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, plain, sf_dir).columns == plain.columns, name
        assert stage(spark, plain.limit(0), sf_dir).count() == 0, name


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert differences(QUERIES[name](spark, sf_dir), con.sql(ORACLES[name])) is None
