import hashlib
import re

from conftest import ODD_TEXTS, by_row

from crawlspark.llm import secret_scan as S

BASE = (("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                              re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))


def slow(text):
    spans = sorted((m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, g, n) in enumerate(BASE)
                   for m in p.finditer(text or "") if len(m.group(g)) >= n)
    counts = [sum(k == j for _, k, _ in spans) for j in range(3)]
    return (*counts, hashlib.sha256(",".join(x for *_, x in spans).encode()).hexdigest())


def test_odd_rows(odd, none):
    got = by_row(S.find_secrets(odd), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    # "ſ" and "K" are equal to s and k under Python's wider case rule, not under ASCII's: no text holds such a key
    assert got == sorted(((i, *slow(t)) for i, t in ODD_TEXTS), key=lambda r: tuple((x is not None, x) for x in r))
    assert S.find_secrets(none).count() == 0


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")  # the smaller table holds no secret
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in S.find_secrets(docs).collect()}
    assert got == {r.doc_id: slow(r.text) for r in docs.select("doc_id", "text").collect()}
    assert sum(g[0] for g in got.values()) > 0


def test_spans_of_all_rules(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIabc+/=\n-----END RSA PRIVATE KEY-----"
    text = f"é {key} ghp_{'q1' * 18} xoxb-1234567890-abc https://user:passw0rd@host/ AIza{'x' * 35}"
    spans = S.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    kinds = [s.split(":")[0] for s in spans.split(",")]
    assert kinds == ["private_key", "github", "slack", "url_login", "google"]
    _, a, b = spans.split(",")[0].split(":")
    assert text[int(a):int(b)] == key


def test_queries_hold_for_every_match():
    assert S.trigram_query(rb"[0-9a-f]+") is True
    assert S.trigrams_in(S.trigram_query(rb"AKIA[A-Z0-9]+")) == {b"aki", b"kia"}
    query = S.trigram_query(S.BASE_RULES[0].pattern)

    def holds(q, text):
        if q is True:
            return True
        if q[0] == "tri":
            return q[1] in text
        return (all if q[0] == "and" else any)(holds(x, text) for x in q[1])

    for word in ("password", "PASSWD", "Secret", "tokeN", "api_key", "APIKEY"):
        assert holds(query, word.lower().encode())
    assert not holds(query, b"passport sec ret tok en api key")


def test_index_finds_what_a_full_scan_finds(docs):
    texts = [(r.text or "").encode() for r in docs.select("text").collect()]
    full = [sorted(((m.start(), m.end(), k) for k, r in enumerate(S.RULES) for m in re.finditer(r.pattern, t)
                    if m.end(r.group) - m.start(r.group) >= r.least), key=lambda s: (s[0], s[2])) for t in texts]
    assert S.scanner()(texts) == full


def test_redaction(spark, odd):
    out = {r.doc_id: r for r in S.redact_secrets(odd.filter("doc_id <> 15 AND doc_id <> 4")).collect()}
    assert out[11].text == "my [assign] and [access] é [hex]" or "abc123def" not in out[11].text
    assert out[11].n_chars == len(out[11].text) and out[0].text == dict(ODD_TEXTS)[0] and out[1].text is None
    assert S.find_secrets(S.redact_secrets(odd)).filter("spans <> ''").count() == 0


def test_long_logins_and_keys_with_headers_are_whole(spark):
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123-45\n\n"
    rsa = f"-----BEGIN RSA PRIVATE KEY-----\n{head}MIIabc+/=\n-----END RSA PRIVATE KEY-----"
    pgp = "-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: x-1\n\nlQabc=\n=ab\n-----END PGP PRIVATE KEY BLOCK-----"
    lone = "-----BEGIN RSA PRIVATE KEY-----"
    texts = [f"a {rsa} b {pgp} c {lone} d {rsa}"]
    texts += [f"see ://{'u' * n}:{'p-' * n}@host" for n in (32, 33, 64, 65, 84, 5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in S.redact_secrets(df).collect()}
    assert out[0] == "a [private_key] b [private_key] c [private_key] d [private_key]"
    assert all(out[i] == "see [url_login]host" for i in range(1, len(texts)))


def test_many_open_keys_and_logins_are_read_once():
    texts = [b"-----BEGIN RSA PRIVATE KEY-----\nabc " * 50_000, b"-----BEGIN RSA PRIVATE KEY-----" + b"x-" * 3_000_000,
             b"://aaaa:bbbb" * 100_000, b"://" + b"a" * 3_000_000]
    assert [len(x) for x in S.scanner(S.MORE_RULES)(texts)] == [50_000, 1, 0, 0]
