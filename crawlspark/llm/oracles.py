"""SQL twins (DuckDB) of the operators that SQL can express."""

from .license_scan import DRIFT, GRAM, SHARE, template_rows

WORD = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS words FROM t),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM t),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i + 7]) AS n FROM places),
hit AS (SELECT DISTINCT doc_id, i + k AS place FROM windows, range(8) r(k) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines.lines) - len(list_distinct(lines.lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         len(lines.lines) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
         length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_letters,
         length(text) - length(replace(text, '!', '')) AS n_marks,
         len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS n_same_next
  FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (
  SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
            + 4 * (100 * n_symbols > 30 * n_words)::BIGINT + 8 * (100 * n_dup_lines > 60 * n_lines)::BIGINT
            + 16 * (100 * n_upper > 50 * n_letters)::BIGINT + 32 * (100 * n_marks > 50 * n_words)::BIGINT
            + 64 * (100 * n_same_next > 30 * n_words)::BIGINT
            + 128 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, fail_bits & 15 = 0 AS kept_v1
FROM b
"""

_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

OP3 = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
ip AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM i WHERE len(w) > 0),
ish AS (SELECT DISTINCT item_id, w[k:k + 4] AS s FROM ip),
dp AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0),
dsh AS (SELECT DISTINCT doc_id, w[k:k + 4] AS s FROM dp WHERE w[k:k + 4] IN (SELECT s FROM ish)),
n AS (SELECT item_id, count(*) AS n_shingles FROM ish GROUP BY item_id),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM dsh JOIN ish USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
FROM f JOIN n USING (item_id) WHERE 10 * n_found >= 8 * n_shingles
"""

OP11 = """
WITH i AS (SELECT item_id, unnest(regexp_extract_all(LOWERED, 'TERM')) AS t FROM benchmark),
q AS (SELECT item_id, t, count(*) AS qtf FROM i GROUP BY ALL),
d AS (SELECT doc_id, unnest(regexp_extract_all(LOWERED, 'TERM')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY t, docs),
m AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // terms AS m FROM n, c),
s AS (SELECT item_id, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN tf USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
""".replace("LOWERED", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')").replace(
    "TERM", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

_TEMPLATES, _RUNS = template_rows()
OP12 = f"""
WITH names(template, label, base, runs) AS (VALUES {', '.join(map(str, _TEMPLATES))}),
grams(template, place, run) AS (VALUES {', '.join(map(str, _RUNS))}),
d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT row, unnest(range(len(w) - {GRAM - 1})) AS pos, w FROM d WHERE len(w) >= {GRAM}),
runs AS (SELECT row, pos, array_to_string(w[pos + 1:pos + {GRAM}], ' ') AS run FROM places),
diagonals AS (SELECT row, template, pos - place AS diagonal, bit_or(1::BIGINT << place) AS mask
              FROM runs JOIN grams USING (run) GROUP BY ALL),
apart AS (SELECT *, (diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) <= {DRIFT}) IS NOT TRUE AS apart
          FROM diagonals),
numbered AS (SELECT *, sum(apart::INTEGER) OVER (PARTITION BY row, template ORDER BY diagonal) AS span FROM apart),
merged AS (SELECT row, template, span, bit_count(bit_or(mask)) AS hits FROM numbered GROUP BY ALL),
good AS (SELECT row, label, hits / runs AS part FROM merged JOIN names USING (template) WHERE hits >= {SHARE} * runs),
base AS (SELECT row, diagonal, label FROM diagonals JOIN names USING (template)
         WHERE base AND mask = (1::BIGINT << runs) - 1),
b AS (SELECT row, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY row),
l AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
      FROM (SELECT row, label FROM good UNION ALL SELECT row, label FROM base) GROUP BY row),
p AS (SELECT row, max(part) AS score FROM good GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN b USING (row) LEFT JOIN l USING (row) LEFT JOIN p USING (row)
"""

# The CRC-32 of the UTF-8 bytes by its table of 256 values; code points of these runs have one or two bytes.
OP13 = r"""
WITH RECURSIVE steps AS (
  SELECT range AS k, range AS c, 0 AS turn FROM range(256)
  UNION ALL
  SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, turn + 1 FROM steps WHERE turn < 8),
crc AS (SELECT list(c ORDER BY k) AS tbl FROM steps WHERE turn = 8),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT doc_id, run, n, tbl, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''),
            lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS bs
          FROM c, crc),
h AS (SELECT doc_id, run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bs),
            lambda x, y: xor(x >> 8, tbl[(xor(x, y) & 255) + 1])), 4294967295) AS h FROM bytes),
v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2)
             ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM pairs GROUP BY word),
best AS (SELECT p.word, min(other) AS form, any_value(top) AS form_n FROM pairs p JOIN near ON p.word = near.word AND other_n = top
         WHERE top >= 5 * n GROUP BY p.word),
walk AS (SELECT word, form AS root, 1 AS steps FROM best UNION ALL SELECT k.word, b.form, steps + 1 FROM walk k JOIN best b ON k.root = b.word),
last AS (SELECT word, arg_max(root, steps) AS root FROM walk GROUP BY word)
SELECT w.word, form, coalesce(root, w.word) AS root, w.n, coalesce(n_near, 0) AS n_near, form_n
FROM w LEFT JOIN near USING (word) LEFT JOIN best USING (word) LEFT JOIN last USING (word)
"""

ORACLES = {"op11_lexical_search": OP11, "op12_license_scan": OP12, "op13_spelling": OP13,
           "op2_quality_rules": OP2, "op3_decontamination": OP3}
