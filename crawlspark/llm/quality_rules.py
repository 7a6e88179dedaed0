"""Quality rules as a ledger: every rule is evaluated once, its failure is one bit, its measurements are stored.

A policy is a named version: a set of rules that reject. Applying another version or asking what a rule alone rejects
are bit operations over the ledger; no text is read again.

Defined cases: a null or empty text has no word and fails ``few_words``; repeated rows and equal doc_ids stay as rows;
an empty table gives an empty ledger and ablations of zero; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_text

WINDOW = 8
MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, "
            "n_upper long, n_letters long, n_marks long, n_same_next long")

# Rule name -> the condition under which a document fails it, over the measures; the place in this dict is its bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 60 * n_lines",
    "upper_case": "100 * n_upper > 50 * n_letters",
    "exclamations": "100 * n_marks > 50 * n_words",
    "echoed_words": "100 * n_same_next > 30 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}
BASE = ("few_words", "repeated_windows")
# Version -> rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "duplicate_lines"),
    "v2": tuple(RULES),
}
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text, the first one included."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    x = (ids.astype(np.uint64) + np.uint64(1)) * MIX[0]
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x ^= x >> np.uint64(27)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h = h * MIX[2] + x[k:k + n]
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(h, twice))
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids, width)[at])  # the words themselves decide
    _, inverse, counts = np.unique(windows.view(np.dtype((np.void, windows.itemsize * width))).ravel(), return_inverse=True,
                                   return_counts=True)
    at = at[counts[inverse.ravel()] > 1]
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()  # bytes: separated by ASCII white space alone
    count = text.count
    string = text.decode("utf-8", "replace")
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    lines = [x for x in text.split(b"\n") if x.strip()]
    raw = np.frombuffer(text, dtype=np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    lower = int(((raw >= 97) & (raw <= 122)).sum())
    return (len(words), len(string) - sum(count(bytes([c])) for c in WHITE), sum(count(bytes([c])) for c in SYMBOLS),
            len(lines) - len(set(lines)), repeated_words(ids), len(lines), upper, upper + lower, count(b"!"),
            int((ids[1:] == ids[:-1]).sum()))


def measurements(docs: DataFrame) -> DataFrame:
    return per_text(docs, MEASURES, lambda: lambda texts: list(zip(*[measure(t) for t in texts])))


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(rules) -> int:
    return sum(bit(r) for r in rules)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, and ``fail_bits``: bit k is set where the k-th rule fails."""
    bits = sum((F.when(F.expr(test), F.lit(bit(rule))).otherwise(F.lit(0)) for rule, test in RULES.items()), F.lit(0))
    return measurements(docs).withColumn("fail_bits", bits.cast("long"))


def passes(version: str, bits: str | Column = "fail_bits") -> Column:
    """Whether a row of the ledger passes the policy of this version."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(mask(POLICIES[version]))) == 0


def ablations(book: DataFrame, versions=tuple(POLICIES)) -> DataFrame:
    """For each version and each of its rules: documents that fail it, and those kept if it alone were dropped."""
    bits = F.col("fail_bits")
    cells = [(v, r) for v in versions for r in POLICIES[v]]
    sums = []
    for i, (version, rule) in enumerate(cells):
        failed = bits.bitwiseAND(F.lit(mask(POLICIES[version])))
        sums += [F.count_if(failed.bitwiseAND(F.lit(bit(rule))) != 0).alias(f"f{i}"),
                 F.count_if(failed == bit(rule)).alias(f"o{i}")]
    one = book.agg(*sums)
    rows = [F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.col(f"f{i}").alias("n_failed"),
                     F.col(f"o{i}").alias("n_only")) for i, (v, r) in enumerate(cells)]
    return one.select(F.inline(F.array(*rows)))
