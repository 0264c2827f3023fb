"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from lattica.llm import licenses, urlfilter

OP1 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, min(page_id) AS f FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN f IS NOT NULL AND page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM f THEN f END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d
"""

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urlfilter.RULES)
OP3 = f"""
WITH u AS (SELECT page_id, html,
                  translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
k AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') END AS key FROM u),
listed AS (SELECT DISTINCT key FROM k WHERE html LIKE '%<br></article>%' AND key IS NOT NULL),
rules(verdict, h, p) AS (VALUES {_RULES}),
fits AS (SELECT page_id, k.host, k.path, max_by(h || p, (length(h || p), rules.verdict = 'block')) AS rule,
                max_by(rules.verdict, (length(h || p), rules.verdict = 'block')) AS by_rule
         FROM k JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT k.page_id, k.host, k.path, f.rule, coalesce(by_rule, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       f.rule IS NULL AND l.key IS NOT NULL AS listed
FROM k LEFT JOIN fits f ON k.page_id = f.page_id LEFT JOIN listed l ON k.key = l.key
"""

OP4 = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, s, hash(array_to_string(list_slice(ws, s + 1, s + 20), ' ')) AS a, md5(array_to_string(list_slice(ws, s + 1, s + 20), ' ')) AS b
      FROM (SELECT doc_id, ws, unnest(range(len(ws) - 19)) AS s FROM w WHERE len(ws) >= 20)),
f AS (SELECT a, b, min((doc_id, s)) AS first FROM v GROUP BY a, b HAVING count(*) > 1),
later AS (SELECT doc_id, s FROM v JOIN f USING (a, b) WHERE (doc_id, s) <> first),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
kept AS (SELECT w.doc_id, x.i, x.word FROM w, (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM w) x
         WHERE w.doc_id = x.doc_id AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND g.i = x.i)),
texts AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM kept GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN texts USING (doc_id)
"""

OP5 = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))
                                           WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x)
SELECT w.doc_id, CASE WHEN len(ws) > 0 THEN min(w.doc_id) OVER (PARTITION BY array_to_string(ws, ' ')) ELSE w.doc_id END AS class_id,
       g.group_id, coalesce(l.n_links, 0)::BIGINT AS n_links
FROM w JOIN (SELECT a, min(b) AS group_id FROM reach GROUP BY a) g ON w.doc_id = g.a
LEFT JOIN (SELECT x, count(*) AS n_links FROM links GROUP BY x) l ON w.doc_id = l.x
"""

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_PHRASES = ", ".join(f"('{p}', '{label}')" for p, label in licenses.PHRASES)
_TEMPLATES = ", ".join(f"('{p}', '{label}')" for p, label in licenses.TEMPLATES)
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP8 = f"""
WITH phrases(p, label) AS (VALUES {_PHRASES}),
templates(t, label) AS (SELECT list_distinct(string_split(t, ' ')), label FROM (VALUES {_TEMPLATES}) x(t, label)),
w AS (SELECT doc_id, text, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS ws FROM documents),
places AS (SELECT doc_id, i, label FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM w) x, (SELECT string_split(p, ' ') AS q, label FROM phrases) y
       WHERE ws[i + 1] = q[1] AND list_slice(ws, i + 1, i + len(q)) = q),
base AS (SELECT doc_id, count(*) AS n, min(i) AS first_place, max(i) AS last_place, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
lines AS (SELECT doc_id, regexp_extract_all({_LOWER.format("line")}, '{_WORD}') AS b FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
hits AS (SELECT doc_id, label, len(list_intersect(t, b)) / len(t) AS c FROM lines, templates WHERE len(list_intersect(t, b)) >= {licenses.THRESHOLD} * len(t) - 1e-9),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS score
          FROM (SELECT doc_id, label, 1.0 AS c FROM places UNION ALL SELECT doc_id, label, c FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_place AS first_word, last_place AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)
"""

OP9 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM (SELECT vec_id, max(v) AS v FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id) q JOIN v c ON q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

OP12 = """
WITH t AS (SELECT conv_id, conv_id - conv_id % 20 AS base, turn, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d
           FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) - 1 AS i FROM t),
c AS (SELECT conv_id, any_value(base) AS base, (4294967295 - list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1),
          lambda k: [ascii(substr(conv_id::VARCHAR, k, 1)), -1, -1, -1, -1, -1, -1, -1, -1]))),
          lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) % 4 AS h FROM t GROUP BY conv_id),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
rebuilt AS (SELECT c.conv_id, o.i AS pos, o.d, o.text FROM c JOIN own o ON o.conv_id = c.base AND o.i < c.h
            UNION ALL SELECT c.conv_id, o.i - c.h + least(c.h, coalesce(n.n, 0)), o.d, o.text FROM c JOIN own o ON o.conv_id = c.conv_id AND o.i >= c.h LEFT JOIN n ON n.conv_id = c.base),
paths AS (SELECT conv_id, '' AS path, '' AS text FROM c UNION ALL SELECT conv_id, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY pos), text FROM rebuilt),
ended AS (SELECT conv_id, arg_max(path, length(path)) AS path FROM paths GROUP BY conv_id),
ends AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS s FROM ended GROUP BY path),
nodes AS (SELECT path, length(path) // 64 AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                 (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\\x20\\x09-\\x0D]+')) AS saved FROM paths GROUP BY path),
kids AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n FROM nodes WHERE path <> '' GROUP BY 1),
up AS (SELECT left(path, 64 * unnest(range(depth + 1))) AS path, saved, (path NOT IN (SELECT path FROM kids))::INT AS leaf FROM nodes),
sums AS (SELECT path, sum(leaf) AS leaves, sum(saved) AS saved FROM up GROUP BY path)
SELECT x.conv_id, x.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n_convs::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.s, sha256('')) AS ends_sha256
FROM nodes x LEFT JOIN nodes p ON x.path <> '' AND p.path = left(x.path, length(x.path) - 64) LEFT JOIN kids k ON k.path = x.path
JOIN sums s ON s.path = x.path LEFT JOIN ends e ON e.path = x.path
"""

OP13 = """
WITH RECURSIVE w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
x AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS m FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN x.doc_id > m OR (x.doc_id IS NULL AND m IS NOT NULL) THEN 'E' ELSE '' END AS fails
      FROM x LEFT JOIN l ON x.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
orders(o) AS (SELECT '' UNION ALL SELECT o || c FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE NOT contains(o, c)),
steps AS (SELECT o, s, substr(o, s, 1) AS c FROM orders, (SELECT unnest(range(1, 6)) AS s) WHERE length(o) = 5),
e AS (SELECT part, o, s, c, n, good, toxic, fails, contains(fails, c) AS hit, length(translate(left(o, s - 1), fails, '')) < s - 1 AS before FROM g, steps),
r AS (SELECT part, o, s, c, sum(n) FILTER (NOT hit AND NOT before) AS kept, sum(n) FILTER (hit AND NOT before) AS removed, sum(n) FILTER (hit AND before) AS redundant,
             sum(n) FILTER (fails = c) AS alone, sum(good) FILTER (hit AND NOT before) AS good, sum(toxic) FILTER (hit AND NOT before) AS toxic FROM e GROUP BY ALL)
SELECT part, o AS filter_order, s::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(alone, 0)::BIGINT AS unique_fails, coalesce(good, 0)::BIGINT AS good_lost, coalesce(toxic, 0)::BIGINT AS toxic_lost,
       sum(coalesce(removed, 0)) OVER (PARTITION BY part, c)::BIGINT AS shapley
FROM r
"""

ORACLE_SQL: dict[str, str] = {
    "op1_warc_archives": OP1,
    "op3_url_filter": OP3,
    "op4_substring_dedup": OP4,
    "op5_ngram_jaccard_join": OP5,
    "op8_license_scan": OP8,
    "op9_exact_top_k": OP9,
    "op12_conversation_trie": OP12,
    "op13_filter_audit": OP13,
}
