"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

from graphloom.llm.licenses import TEMPLATES, block_class

WORDS = r"'[^\x20\x09-\x0D]+'"

OP2 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<', '\l')) AS text_chars,
    length(replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g')) AS role_chars,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS merged
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + CASE WHEN merged THEN 3 ELSE 16 + role_chars END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP7 = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS weight FROM d GROUP BY source),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS r FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM c),
t AS (SELECT source, source_size, least(cap, coalesce(max(own) FILTER (own <= r) OVER (), 0) * weight)::DOUBLE AS target FROM l),
m AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  ('0x' || substr(md5(concat_ws(':', '7', d.doc_id, d.size)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM m
"""

_NOTICES = ", ".join(f"({i}, {block_class(text)}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))
_BLOCKS = " UNION ALL ".join(f"SELECT rid, {c} AS class, list_distinct(ws[k * {c} + 1 : k * {c} + {2 * c}]) AS tokens FROM (SELECT rid, ws, unnest(range(0, greatest(len(ws) - 1, 0) // {c} + 1)) AS k FROM w)" for c in sorted({block_class(text) for _, text in TEMPLATES}))
OP9 = rf"""
WITH notices AS (SELECT i, class, label, list_distinct(list_filter(string_split_regex(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS tokens FROM (VALUES {_NOTICES}) n(i, class, label, text)),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, list_filter(string_split_regex(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT rid, unnest([
    {{'label': 'mit', 'at': list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'mit' AND ws[i + 1] = 'license')}},
    {{'label': 'apache', 'at': list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'apache' AND ws[i + 1] = 'license')}},
    {{'label': 'gpl', 'at': list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'general' AND ws[i + 1] = 'public' AND ws[i + 2] = 'license')}}]) AS p FROM w),
b AS (SELECT rid, sum(len(p.at)) AS n_base, min(list_min(p.at)) - 1 AS first_word, max(list_max(p.at)) - 1 AS last_word,
  list(DISTINCT p.label) FILTER (len(p.at) > 0) AS labels FROM p GROUP BY rid),
blocks AS ({_BLOCKS}),
h AS (SELECT rid, label, len(list_intersect(blocks.tokens, notices.tokens)) / len(notices.tokens)::DOUBLE AS containment FROM blocks JOIN notices USING (class)
  WHERE len(list_intersect(blocks.tokens, notices.tokens)) >= 0.8 * len(notices.tokens)),
g AS (SELECT rid, list(DISTINCT label) AS labels, max(containment) AS best FROM h GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, n_base::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(g.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM w JOIN b USING (rid) LEFT JOIN g USING (rid)
"""

OP8 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [ws] ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3]) END) AS shingles FROM w),
x AS MATERIALIZED (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS g FROM s),
c AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS shared
  FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM c WHERE 100 * shared >= 85 * (an + bn - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
d AS (SELECT doc_id, count(DISTINCT o.shingles) AS n_links FROM (SELECT e.a AS doc_id, list_sort(y.shingles) AS shingles, list_sort(z.shingles) AS own
  FROM e JOIN s y ON y.doc_id = e.b JOIN s z ON z.doc_id = e.a) o WHERE shingles <> own GROUP BY doc_id)
SELECT s.doc_id, len(shingles)::BIGINT AS n_shingles, m.component_id, coalesce(d.n_links, 0)::BIGINT AS n_links
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = s.doc_id LEFT JOIN d ON d.doc_id = s.doc_id
"""

SQL = {"op8_ngram_jaccard_join": OP8, "op2_chat_formatting": OP2, "op7_source_mixing": OP7, "op9_license_scan": OP9}
