"""The SQL of the operators that SQL can express."""

from codeloom.llm.url_filter import BASE_RULES, OWN_RULES

OP1 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
v AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM v WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_distinct(w)) AS n_distinct,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words * 3 OR n_capitals * 10 > word_chars * 4 OR n_exclamations * 2 > n_words
            OR n_dup_lines * 2 > n_lines OR word_chars < n_words * 2 OR word_chars > n_words * 15 OR n_distinct * 20 < n_words) AS kept
FROM b"""

_RULES = ", ".join(f"('{h}', '{p}', '{x}', {b})" for h, p, x, b in BASE_RULES + OWN_RULES)

OP6 = rf"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
b AS (
  SELECT q.r, q.page_id, q.host, q.path, arg_max({{'n': u.h || u.p, 'v': u.v, 'b': u.b}}, length(u.h || u.p) + CASE WHEN u.b THEN 1000000 ELSE 0 END) AS best
  FROM q LEFT JOIN (VALUES {_RULES}) u(h, p, v, b)
    ON (q.host = u.h OR ends_with(q.host, '.' || u.h)) AND starts_with(q.path, u.p)
  GROUP BY ALL)
SELECT page_id, host, path, CASE WHEN best.b THEN best.n END AS rule, coalesce(best.v, 'allow') AS verdict FROM b"""

OP12 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.x, p.y FROM p JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y WHERE 100 * p.both >= 80 * (a.n + b.n - p.both)),
r AS (SELECT x AS doc_id, y AS root FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.root),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.root, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.root, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"""

#: Of operators that SQL can't express as a whole, the columns that the contract fixes.
BASE_PLACES = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (
  SELECT doc_id, w, list_filter(range(len(w)), lambda i: w[i + 1] = 'cc' AND w[i + 2] = 'by') AS a,
         list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS b,
         list_filter(range(len(w)), lambda i: w[i + 1] = 'all' AND w[i + 2] = 'rights' AND w[i + 3] = 'reserved') AS c
  FROM d)
SELECT doc_id, len(w) AS n_words, len(a) + len(b) + len(c) AS n_base, list_min(a || b || c) AS first_word, list_max(a || b || c) AS last_word,
       array_to_string(list_filter([CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL), ',') AS base_labels
FROM p"""

EDITED = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) // 4 AS k, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS f FROM d)
SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - k) || left(f, k)) AS edited_sha256 FROM n"""

_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr({_DIGITS}, length({_DIGITS}) - i, 1) AS INTEGER) ELSE (2 * CAST(substr({_DIGITS}, length({_DIGITS}) - i, 1) AS INTEGER)) // 10 + (2 * CAST(substr({_DIGITS}, length({_DIGITS}) - i, 1) AS INTEGER)) % 10 END)) % 10 = 0"
PERSONAL = rf"""
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS n_email,
       len(list_filter(regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: coalesce(TRY_CAST(p AS INTEGER), 999))) <= 255)) AS n_ip,
       len(list_filter(regexp_extract_all(t, '[0-9](?:[ -]?[0-9])+'), lambda x: length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN})) AS n_card,
       len(list_filter(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: length({_DIGITS}) BETWEEN 9 AND 15)) AS n_phone
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""

DEVIATIONS = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT) + 100000) AS x FROM embeddings
  WHERE len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
e AS (SELECT vec_id, unnest(range(1, len(x) + 1)) AS k, unnest(x) AS x FROM v),
s AS (SELECT k, count(*) AS n, sum(x) AS s FROM e GROUP BY k)
SELECT e.vec_id, s.n, CAST(sum((s.n * e.x - s.s) * (s.n * e.x - s.s)) AS BIGINT) AS deviation FROM e JOIN s ON s.k = e.k GROUP BY ALL"""

ORACLE_SQL = {"op1_quality_rules": OP1, "op6_url_filters": OP6, "op12_minhash_dedup": OP12, "vector_deviations": DEVIATIONS, "base_license_places": BASE_PLACES, "edited_texts": EDITED, "base_personal_data": PERSONAL}
