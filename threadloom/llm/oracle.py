"""SQL twins of the queries that SQL can express. Constants are spelt out, not imported."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOLDED = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLAIN = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE k * 10 >= 8 * (p.n + q.n - k)),
r(doc_id, other) AS (SELECT x, y FROM l UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(other) FROM r WHERE r.doc_id = d.doc_id), d.doc_id)) AS class_id,
  coalesce((SELECT count(*) FROM l WHERE l.x = d.doc_id), 0) AS n_links, coalesce(n.n, 0) AS set_size
FROM d LEFT JOIN n USING (doc_id)
"""

OP4 = f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
i AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k,
    unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda p: array_to_string(w[p:p + least(len(w), 10) - 1], ' '))) AS g
  FROM i WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM d, k WHERE len(w) >= k),
m AS (SELECT doc_id, dw.k, p, item_id FROM dw JOIN iw ON iw.k = dw.k AND iw.g = array_to_string(w[p:p + dw.k - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY 1),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_MEASURES = """
  VALUES ('length', 300), ('symbols', 30), ('dup_lines', 60), ('repeats', 30), ('capitals', 30)
"""

OP5 = rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, {_PLAIN} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
    SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, array_to_string(w[p:p + 4], ' ') AS g FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM g WHERE c > 1) GROUP BY 1),
m AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals
  FROM d LEFT JOIN rep USING (doc_id)),
v AS (
  SELECT lang, source, measure, (v >> s) << s AS v, count(*) AS n FROM (
    SELECT lang, source, measure, v, greatest(length(bin(v)) - 6, 0) AS s FROM (
      SELECT lang, source, 'length' AS measure, 1000 * word_chars // n_words AS v FROM m WHERE n_words > 0
      UNION ALL SELECT lang, source, 'symbols', 1000 * n_symbols // n_words FROM m WHERE n_words > 0
      UNION ALL SELECT lang, source, 'dup_lines', 1000 * n_dup_lines // n_lines FROM m WHERE n_words > 0
      UNION ALL SELECT lang, source, 'repeats', 1000 * n_repeat_words // n_words FROM m WHERE n_words > 0
      UNION ALL SELECT lang, source, 'capitals', 1000 * n_capitals // word_chars FROM m WHERE n_words > 0))
  GROUP BY ALL),
levels AS (
  SELECT 's' AS level, lang, source, measure, v, n FROM v
  UNION ALL SELECT 'l', lang, NULL, measure, v, sum(n) FROM v GROUP BY ALL
  UNION ALL SELECT 'a', NULL, NULL, measure, v, sum(n) FROM v GROUP BY ALL),
u AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total,
    sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY v) AS upto FROM levels),
q AS (
  SELECT level, lang, source, measure, max(total) AS total, min(v) FILTER (WHERE 4 * upto >= total) AS low,
    min(v) FILTER (WHERE 4 * upto >= 3 * total) AS high FROM u GROUP BY ALL),
f AS (SELECT q.*, greatest(high - low, floor_) AS wide FROM q JOIN ({_MEASURES}) x(measure, floor_) USING (measure)),
o AS (
  SELECT s.lang, s.source, s.measure, s.total AS n, s.low, s.high, s.wide,
    CASE WHEN l.total >= 200 THEN l.low ELSE a.low END AS ol, CASE WHEN l.total >= 200 THEN l.high ELSE a.high END AS oh,
    CASE WHEN l.total >= 200 THEN l.wide ELSE a.wide END AS ow
  FROM f s JOIN f l ON s.level = 's' AND l.level = 'l' AND l.lang IS NOT DISTINCT FROM s.lang AND l.measure = s.measure
  JOIN f a ON a.level = 'a' AND a.measure = s.measure),
b AS (
  SELECT lang, source, measure,
    least(CASE WHEN n >= 200 THEN high + 3 * wide ELSE oh + 3 * ow END, oh + 6 * ow) AS high,
    greatest(CASE WHEN n >= 200 THEN low - 3 * wide ELSE ol - 3 * ow END, ol - 6 * ow) AS low FROM o),
e AS (
  SELECT lang, source, max(high) FILTER (WHERE measure = 'length') AS lh, max(low) FILTER (WHERE measure = 'length') AS ll,
    max(high) FILTER (WHERE measure = 'symbols') AS sh, max(high) FILTER (WHERE measure = 'dup_lines') AS dh,
    max(high) FILTER (WHERE measure = 'repeats') AS rh, max(high) FILTER (WHERE measure = 'capitals') AS ch FROM b GROUP BY 1, 2),
j AS (
  SELECT m.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    1000 * n_symbols > sh * n_words + 4000 OR 1000 * n_dup_lines > dh * n_lines + 2000
    OR 1000 * n_repeat_words > rh * n_words + 10000 OR 1000 * n_capitals > ch * word_chars + 30000
    OR (1000 * word_chars > lh * n_words AND CAST(1000 * word_chars - lh * n_words AS DOUBLE) ^ 2 > 81000000.0 * n_words)
    OR (1000 * word_chars < ll * n_words AND CAST(1000 * word_chars - ll * n_words AS DOUBLE) ^ 2 > 81000000.0 * n_words) AS wrong
  FROM m LEFT JOIN e ON m.lang IS NOT DISTINCT FROM e.lang AND m.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, base_failed,
  NOT (base_failed OR coalesce(wrong, false)) AS kept FROM j
"""

_ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
_KINDS = [
    ("assign", _ASSIGN), ("access", "AKIA[A-Z0-9]{14,}"), ("hex", "[0-9a-f]{16,}"),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), ("hosted", "gh[pousr]_[A-Za-z0-9]{36,}"),
    ("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"), ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
]
_EACH = "\nUNION ALL ".join(
    f"SELECT doc_id, {i} AS k, '{kind}' AS kind, unnest(regexp_extract_all(t, '{pattern}')) AS hit,"
    f" unnest(string_split_regex(t, '{pattern}')[:-2]) AS gap,"
    f" unnest(regexp_extract_all(t, '{pattern}', {2 if kind == 'assign' else 0})) AS val,"
    f" unnest(range(1, len(regexp_extract_all(t, '{pattern}')) + 1)) AS i FROM d"
    for i, (kind, pattern) in enumerate(_KINDS)
)

OP7 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS ({_EACH}),
p AS (
  SELECT doc_id, k, kind, hit, val, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM e),
s AS (
  SELECT doc_id, k, kind, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop
  FROM p WHERE k <> 0 OR length(val) >= 12),
x AS (SELECT *, kind || ':' || start || ':' || stop AS line FROM s),
a AS (
  SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access,
    count(*) FILTER (WHERE k = 2) AS n_hex, string_agg(line, ',' ORDER BY start, k) FILTER (WHERE k < 3) AS base,
    string_agg(line, ',' ORDER BY start, k) AS spans FROM x GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""

OP9 = """
WITH s AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT CASE WHEN coalesce(turn, -1) < 2 THEN conv_id ELSE conv_id - 1 END, 'rejected', turn, role, text
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (
  SELECT pair_id, side, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos
  FROM s),
b AS (
  SELECT pair_id, pos, count(*) < 2 OR min(role || chr(0) || text) <> max(role || chr(0) || text) AS differs FROM t GROUP BY 1, 2),
l AS (SELECT pair_id, coalesce(min(pos) FILTER (WHERE differs), max(pos) + 1) AS prefix_turns FROM b GROUP BY 1),
r AS (
  SELECT pair_id, CASE WHEN pos < prefix_turns THEN 'prompt' ELSE side END AS part, prefix_turns, role, text,
    CASE WHEN pos < prefix_turns THEN pos ELSE pos - prefix_turns END AS place,
    '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS shown
  FROM t JOIN l USING (pair_id) WHERE pos >= prefix_turns OR side = 'chosen'),
p AS (
  SELECT *, place // 64 AS part_no,
    coalesce(sum(length(shown)) OVER (PARTITION BY pair_id, part, place // 64 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + length(role) + 5 AS start FROM r)
SELECT pair_id, part, part_no, count(*) AS n_turns, any_value(prefix_turns) AS prefix_turns,
  string_agg(shown, '' ORDER BY place) AS text,
  coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(text) + 8 AS BIGINT), ',' ORDER BY place)
    FILTER (WHERE part <> 'prompt' AND role = 'assistant'), '') AS loss_spans
FROM p GROUP BY pair_id, part, part_no
"""

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard": OP1,
    "op4_decontamination": OP4,
    "op5_quality_rules": OP5,
    "op7_secret_scan": OP7,
    "op9_preferences": OP9,
}
