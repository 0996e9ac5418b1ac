"""SQL of the queries of operators 11 to 13, for another engine."""

from __future__ import annotations

from siltstone.llm import license_scan

OP11_SQL = r"""
WITH s AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT r, doc_id, len(w) AS n, w FROM s WHERE len(w) > 0),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS t FROM d) GROUP BY ALL),
q AS (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
i AS (SELECT item_id, text, t, count(*) AS times FROM q GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p CROSS JOIN g WHERE t IN (SELECT t FROM i) GROUP BY t, docs),
c AS (SELECT item_id, text, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
      FROM i JOIN w USING (t) JOIN p USING (t) CROSS JOIN g GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""

_CRC32 = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: ascii(CAST(doc_id AS VARCHAR)[k])::BIGINT)), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]))"""

OP12_SQL = rf"""
WITH RECURSIVE e(i, k, c) AS (SELECT range, 0, range::BIGINT FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM e WHERE k < 8),
z AS (SELECT list(c ORDER BY i) AS tab FROM e WHERE k = 8),
f AS (SELECT row_number() OVER () AS r, doc_id, source, text, concat_ws('', CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(doc_id::VARCHAR), ':', doc_id) END,
        CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END, CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END,
        CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(n_chars::VARCHAR), ':', n_chars) END) AS head FROM documents),
l AS (SELECT r, doc_id, source, sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS leaf,
        CASE WHEN text IS NOT NULL AND doc_id IS NOT NULL AND xor({_CRC32}, 4294967295) % 2 = 0
             THEN sha256(concat(head, strlen(replace(text, chr(10), '')), ':', replace(text, chr(10), ''))) END AS changed FROM f CROSS JOIN z),
o AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
up(lvl, s, idx, d, n) AS (
  SELECT 0, s, pos, leaf, count(*) OVER (PARTITION BY s) FROM o
  UNION ALL SELECT lvl + 1, s, idx // 3, sha256(string_agg(d, '' ORDER BY idx)), any_value((n + 2) // 3) FROM up WHERE n > 1 GROUP BY lvl, s, idx // 3),
sub AS (SELECT s, d AS subroot FROM up WHERE n = 1),
top(lvl, idx, d, n) AS (
  SELECT 0, s, subroot, count(*) OVER () FROM sub
  UNION ALL SELECT lvl + 1, idx // 3, sha256(string_agg(d, '' ORDER BY idx)), any_value((n + 2) // 3) FROM top WHERE n > 1 GROUP BY lvl, idx // 3),
own AS (SELECT a.s, a.lvl, a.idx, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS before, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS after
        FROM up a JOIN up b ON a.s = b.s AND a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL),
high AS (SELECT a.lvl, a.idx, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS before, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS after
         FROM top a JOIN top b ON a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL),
steps AS (SELECT r, lvl, before, after FROM o JOIN own ON own.s = o.s AND own.idx = o.pos // CAST(pow(3, lvl) AS BIGINT)
          UNION ALL SELECT r, 1000 + lvl, before, after FROM o JOIN high ON high.idx = o.s // CAST(pow(3, lvl) AS BIGINT)),
nth AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY lvl) AS k, before, after FROM steps),
fold(r, k, d) AS (SELECT r, 0, coalesce(changed, leaf) FROM o UNION ALL SELECT fold.r, fold.k + 1, sha256(concat(before, d, after)) FROM fold JOIN nth ON nth.r = fold.r AND nth.k = fold.k + 1),
last AS (SELECT r, arg_max(d, k) AS folded FROM fold GROUP BY r),
proof AS (SELECT o.r, sha256(coalesce(string_agg(concat(before, after), '' ORDER BY k), '')) AS p FROM o LEFT JOIN nth ON nth.r = o.r GROUP BY o.r)
SELECT doc_id, leaf, subroot, top.d AS root, p AS proof_sha256, folded AS folded_root, folded = top.d AS verified
FROM o JOIN sub USING (s) JOIN last USING (r) JOIN proof USING (r) CROSS JOIN top WHERE top.n = 1
"""


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op13_sql() -> str:
    p = license_scan.ScanParams()
    words = lambda c: rf"regexp_extract_all(translate(coalesce({c}, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '{license_scan.WORD}')"
    return rf"""
WITH tpl AS (SELECT t, label, {words('body')} AS tw FROM (VALUES {', '.join(f'({t}, {_q(label)}, {_q(text)})' for t, (label, text) in enumerate(p.templates))}) v(t, label, body)),
ph AS (SELECT string_split(phrase, ' ') AS pw, name FROM (VALUES {', '.join(f'({_q(a)}, {_q(b)})' for a, b in p.phrases.items())}) v(phrase, name)),
s AS (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS w FROM documents),
pos AS (SELECT r, w, unnest(range(len(w))) AS i FROM s),
bp AS (SELECT r, i, name FROM pos JOIN ph ON pw[1] = w[i + 1] WHERE w[i + 1:i + len(pw)] = pw),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT name) AS own FROM bp GROUP BY r),
tg AS (SELECT t, q, array_to_string(tw[q + 1:q + {p.gram}], ' ') AS g FROM (SELECT t, tw, unnest(range(len(tw) - {p.gram - 1})) AS q FROM tpl)),
h AS (SELECT DISTINCT r, t, i AS p, q FROM pos JOIN tg ON g = array_to_string(w[i + 1:i + {p.gram}], ' ') WHERE i + {p.gram} <= len(w)),
d AS (SELECT r, t, p - q AS d, list(DISTINCT q) AS qs FROM h GROUP BY ALL),
n AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY r, t ORDER BY d) <= {p.gap} THEN 0 ELSE 1 END AS new FROM d),
m AS (SELECT *, sum(new) OVER (PARTITION BY r, t ORDER BY d) AS run FROM n),
l AS (SELECT *, (d - min(d) OVER (PARTITION BY r, t, run)) // {p.width} AS part FROM m),
g AS (SELECT r, t, list(d) AS ds, list_distinct(flatten(list(qs))) AS qs FROM l GROUP BY r, t, run, part HAVING len(list_distinct(flatten(list(qs)))) >= {p.votes}),
u AS (SELECT r, label, tw, w, unnest(range(len(tw))) AS q, ds, row_number() OVER () AS grp FROM g JOIN tpl USING (t) JOIN s USING (r)),
c AS (SELECT r, label, grp, count(*) FILTER (WHERE len(list_filter(ds, lambda x: q + x >= 0 AND w[q + x + 1] = tw[q + 1])) > 0) / count(*) AS coverage FROM u GROUP BY r, label, grp),
v AS (SELECT r, max(coverage) AS coverage, list(DISTINCT label) FILTER (WHERE coverage >= {p.least}) AS more FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(own, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(coverage, 0) END AS score
FROM s LEFT JOIN b USING (r) LEFT JOIN v USING (r)
"""
