"""Secret scan over trigram indexes.

Each slab of texts gets an inverted index: for every trigram that some rule needs, the ascending list of its texts. A
rule's Boolean trigram query is derived from its regex by Python's own regex parser: literal runs give trigrams that
must all occur, branches give alternatives, and what may be left out gives nothing. The postings are intersected and
united, and only the texts that remain are searched with the regex. A rule with no mandatory trigram (``hex``) searches
every text. Trigrams are compared without regard to ASCII case, so the index can only let too much through.

Defined cases: a null or empty text has no span; repeated rows and equal doc_ids stay as rows; an empty table gives an
empty result; other columns are not read. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
from pyspark.sql import DataFrame

from .common import per_text, replace_texts


@dataclass(frozen=True)
class Rule:
    """A kind of secret: the regex (over UTF-8 bytes), the group whose length counts, and the least length."""

    kind: str
    pattern: bytes
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", rb"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", rb"[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    # Anything up to the END line, but not past another key's BEGIN line, so that a text is read once.
    Rule("private_key", rb"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----(?:(?:[^-]|-(?!----(?:BEGIN|END) [A-Z ]*PRIVATE KEY))*+"
                        rb"-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----)?"),
    Rule("github", rb"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}"),
    Rule("slack", rb"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", rb"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", rb"://[^\s/:@]+:[^\s/:@]{4,}@"),
)
RULES = BASE_RULES + MORE_RULES

# A query is True (no demand), ("and", queries), ("or", queries) or ("tri", folded trigram).
FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def both(a, b):
    return b if a is True else a if b is True else ("and", (a, b))


def either(queries):
    return True if any(q is True for q in queries) else queries[0] if len(queries) == 1 else ("or", tuple(queries))


def of_run(run: bytes):
    query = True
    for i in range(len(run) - 2):
        query = both(query, ("tri", run[i:i + 3]))
    return query


def exact_strings(items, limit: int = 32) -> list[bytes] | None:
    """All folded strings a piece of a regex can match, where they are few."""
    out = [b""]
    for op, arg in items:
        if op is C.LITERAL:
            more = [bytes([arg]).translate(FOLD)]
        elif op is C.SUBPATTERN:
            more = exact_strings(arg[-1], limit)
        elif op is C.BRANCH:
            parts = [exact_strings(x, limit) for x in arg[1]]
            more = None if any(p is None for p in parts) else [s for p in parts for s in p]
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            more = sorted({bytes([v]).translate(FOLD) for _, v in arg})
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 6:
            inner = exact_strings(arg[2], limit)
            more = None
            if inner is not None:
                more, power = [], [b""]
                for k in range(arg[1] + 1):
                    more += power if k >= arg[0] else []
                    power = [p + s for p in power for s in inner][: limit + 1]
        elif op is C.AT:
            more = [b""]
        else:
            more = None
        if more is None or len(out) * len(more) > limit:
            return None
        out = [a + b for a in out for b in more]
    return out


def derive(items):
    """The Boolean trigram query that every match of the parsed regex satisfies."""
    query, run = True, [b""]  # run: the strings that end the exact part so far

    def close():
        nonlocal query, run
        query, run = both(query, either([of_run(s) for s in run])), [b""]

    for item in items:
        op, arg = item
        exact = exact_strings([item])
        if exact is not None and len(run) * len(exact) <= 64:
            run = [a + b for a in run for b in exact]
            continue
        close()
        if op is C.SUBPATTERN:
            query = both(query, derive(arg[-1]))
        elif op is C.BRANCH:
            query = both(query, either([derive(x) for x in arg[1]]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            query = both(query, derive(arg[2]))
    close()
    return query


def trigram_query(pattern: bytes):
    return derive(_parser.parse(pattern))


def trigrams_in(query) -> set[bytes]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams_in, query[1]))


class TrigramIndex:
    """Postings (ascending text numbers) of the wanted trigrams over one slab of texts."""

    def __init__(self, texts: list[bytes], wanted: np.ndarray):
        sizes = np.array([len(t) + 1 for t in texts])
        raw = np.frombuffer(b"\n".join(texts).translate(FOLD) + b"\n", dtype=np.uint8).astype(np.uint32)
        codes = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:] if len(raw) > 2 else np.empty(0, np.uint32)
        table = np.zeros(1 << 24, dtype=bool)
        table[wanted] = True
        at = np.flatnonzero(table[codes])
        pairs = np.unique((codes[at].astype(np.int64) << 32) | np.searchsorted(np.cumsum(sizes), at, side="right"))
        self.count = len(texts)
        self.postings = {}
        for group in np.split(pairs, np.flatnonzero(np.diff(pairs >> 32)) + 1) if len(pairs) else []:
            self.postings[int(group[0] >> 32)] = group & 0xFFFFFFFF

    def texts_for(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.count)
        if query[0] == "tri":
            return self.postings.get(int.from_bytes(query[1], "big"), np.empty(0, np.int64))
        lists = [self.texts_for(q) for q in query[1]]
        out = lists[0]
        for other in lists[1:]:
            out = np.intersect1d(out, other, assume_unique=True) if query[0] == "and" else np.union1d(out, other)
        return out


def scanner(rules=RULES):
    """Returns a function: texts -> for each text its spans (start, end, rule number) as byte offsets, in order."""
    compiled = [(re.compile(r.pattern), r.group, r.least) for r in rules]
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = np.array(sorted({int.from_bytes(t, "big") for q in queries for t in trigrams_in(q)}), dtype=np.int64)

    def scan(texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        index, out = TrigramIndex(texts, wanted), [[] for _ in texts]
        for k, ((regex, group, least), query) in enumerate(zip(compiled, queries)):
            for i in index.texts_for(query).tolist():
                for m in regex.finditer(texts[i]):
                    if m.end(group) - m.start(group) >= least:
                        out[i].append((m.start(), m.end(), k))
        for spans in out:
            spans.sort(key=lambda s: (s[0], s[2]))
        return out

    return scan


def to_code_points(text: bytes, spans):
    """The spans with offsets in code points."""
    if not spans or text.isascii():
        return spans
    before = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(before[a]), int(before[b]), k) for a, b, k in spans]


def find_secrets(docs: DataFrame, rules=RULES, base: int = len(BASE_RULES)) -> DataFrame:
    """doc_id, a count for each base kind, the digest of the base spans, and all spans as kind:start:end."""
    names = [r.kind for r in rules]

    def start():
        scan = scanner(rules)

        def run(texts):
            found = [to_code_points(t, s) for t, s in zip(texts, scan(texts))]
            counts = [[sum(s[2] == k for s in spans) for spans in found] for k in range(base)]
            written = [[f"{names[k]}:{a}:{b}" for a, b, k in spans] for spans in found]
            plain = [",".join(w for w, s in zip(ws, spans) if s[2] < base) for ws, spans in zip(written, found)]
            return [*counts, [hashlib.sha256(x.encode()).hexdigest() for x in plain], [",".join(ws) for ws in written]]

        return run

    fields = ", ".join([*[f"n_{n} long" for n in names[:base]], "base_sha256 string", "spans string"])
    return per_text(docs, fields, start)


def redact_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """Every row; each stretch covered by spans becomes ``[kind]`` of the first of them. Texts without one stay."""
    names = [r.kind.encode() for r in rules]

    def start():
        scan = scanner(rules)

        def cleaned(text, spans):
            if not spans:
                return None
            out, at = [], 0
            for a, b, k in spans:
                if a >= at:
                    out += [text[at:a], b"[" + names[k] + b"]"]
                at = max(at, b)
            return b"".join([*out, text[at:]])

        return lambda texts: [cleaned(t, s) for t, s in zip(texts, scan(texts))]

    return replace_texts(docs, start)
