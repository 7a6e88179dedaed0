import re
from collections import Counter

from conftest import ODD_TEXTS, by_row
from pyspark.sql import functions as F

from crawlspark.llm import quality_rules as Q


def slow_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_odd_rows(odd, none):
    got = by_row(Q.ledger(odd), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = sorted(((i, *slow_measures(t)) for i, t in ODD_TEXTS), key=lambda r: tuple((x is not None, x) for x in r))
    assert got == want
    assert Q.ledger(none).count() == 0
    assert {(r.n_failed, r.n_only) for r in Q.ablations(Q.ledger(none)).collect()} == {(0, 0)}


def test_repeated_windows_are_exact():
    import numpy as np

    for words in ("a b c d e f g h a b c d e f g h", "a a a a a a a a a", "a b a b a b a b a b", "a b c d e f g h i"):
        ids = np.array([ord(w) for w in words.split()])
        assert Q.repeated_words(ids) == slow_measures(words)[4]


def test_policies_and_ablations_read_bits_alone(odd):
    book = Q.ledger(odd).cache()
    rows = book.collect()
    names = list(Q.RULES)
    for r in rows:
        failed = {n for k, n in enumerate(names) if r.fail_bits >> k & 1}
        assert ("few_words" in failed) == (r.n_words < 20)
        assert ("repeated_windows" in failed) == (100 * r.n_repeat_words > 30 * r.n_words)
    for version, rules in Q.POLICIES.items():
        kept = book.filter(Q.passes(version)).count()
        assert kept == sum(not any(r.fail_bits & Q.bit(x) for x in rules) for r in rows)
    table = {(r.version, r.rule): (r.n_failed, r.n_only) for r in Q.ablations(book).collect()}
    for version, rules in Q.POLICIES.items():
        for rule in rules:
            own = [r.fail_bits & Q.mask(rules) for r in rows]
            assert table[version, rule] == (sum(1 for x in own if x & Q.bit(rule)), sum(1 for x in own if x == Q.bit(rule)))


def test_good_documents_are_kept(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = Q.ledger(docs).join(labels, "doc_id").filter("quality = 1")
    base = F.col("fail_bits").bitwiseAND(F.lit(Q.mask(Q.BASE))) != 0
    assert good.filter(~base & ~Q.passes("v2")).count() == 0
