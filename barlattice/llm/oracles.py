"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

from .url_filter import PATTERNS

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, list_slice(w, p, p + least(10, len(w)) - 1) AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT r, p, size, list_slice(w, p, p + size - 1) AS win FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT r, p, dw.size, item_id FROM dw JOIN bw ON dw.win = bw.win),
pos AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM (SELECT DISTINCT r, p, size FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""

OP10 = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
c AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM u),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '/.*$', 0, 's') AS path FROM c),
r(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
words(word, verdict) AS (VALUES PATTERN_VALUES),
m AS (SELECT page_id, host, path,
        (SELECT max_by(rhost || rpath || ' ' || verdict, length(rhost || rpath)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS best,
        (SELECT max_by(words.verdict, 2 * length(word) + CASE words.verdict WHEN 'block' THEN 1 ELSE 0 END) FROM words WHERE regexp_matches(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), word, 's')) AS own
      FROM h)
SELECT page_id, host, path, CASE WHEN best IS NOT NULL THEN split_part(best, ' ', 1) END AS rule,
       CASE WHEN best IS NOT NULL THEN split_part(best, ' ', 2) ELSE coalesce(own, 'allow') END AS verdict
FROM m
""".replace("PATTERN_VALUES", ", ".join(f"('{r.pattern}', '{r.verdict}')" for r in PATTERNS))

OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT r, list_slice(w, p, p + least(5, len(w)) - 1) AS g FROM (SELECT r, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
i AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
e AS (SELECT x AS a, y AS b FROM l UNION SELECT y, x FROM l),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
least_of AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN d ON d.r = b GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (r) JOIN least_of ON a = d.r
"""

OP9 = """
WITH RECURSIVE e AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
v AS (SELECT r, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS norm FROM e WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.9),
reach(a, b) AS (SELECT r, r FROM e UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN e ON e.r = b GROUP BY a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c ON c.a = e.r LEFT JOIN k ON k.a = e.r
"""

ORACLES: dict[str, str] = {"op1_decontamination": OP1, "op5_ngram_jaccard": OP5, "op10_url_filters": OP10, "op9_embedding_dedup": OP9}

#: crc32 over a list of bytes: the usual table, made from its polynomial.
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
_BYTES = "flatten(list_transform(string_split({}, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] ELSE [192 + ord(ch)::BIGINT // 64, 128 + ord(ch)::BIGINT % 64] END))"
_CRC = "xor(list_reduce(list_concat([4294967295], {}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"

OP11 = rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, {_LOWER.format('run')} AS run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
h AS (SELECT run, n, {_CRC.format(_BYTES.format("coalesce(CAST(doc_id AS VARCHAR), ' ') || ':' || run"))} AS h FROM r, crc),
c AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
k AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n AS m FROM k a JOIN k b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT k.word, v.word, v.n FROM k JOIN v ON k.rest = v.word UNION SELECT v.word, k.word, k.n FROM k JOIN v ON k.rest = v.word),
b AS (SELECT word, count(*) AS n_near, min({{'m': -m, 'near': near}}) AS best FROM p GROUP BY word),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * n THEN best.near END AS form, CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n FROM v LEFT JOIN b USING (word)),
up(word, root, next) AS (SELECT word, word, form FROM f UNION ALL SELECT up.word, up.next, f.form FROM up JOIN f ON f.word = up.next)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN up ON f.word = up.word AND up.next IS NULL
"""

ORACLES["op11_spelling"] = OP11

OP12 = rf"""
WITH RECURSIVE {_CRC_TABLE},
c AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {_CRC.format(_BYTES.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"))} % 20 AS h FROM conversations, crc),
d AS (SELECT c, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
      FROM c WHERE h <> 0),
o AS MATERIALIZED (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS ini,
        right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS fin FROM d),
f AS MATERIALIZED (SELECT *, CASE WHEN fin = '' THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'd' WHEN fin NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
        lag(ini) OVER (PARTITION BY c ORDER BY i) || ini NOT IN ('su', 'ua', 'au') AS illegal FROM o),
n AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS rows FROM f GROUP BY c),
ins(st, nst, k, audit, said) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (0, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 3, 'I', ['user:']), (1, 3, 6, 'II', ['user:', 'assistant:']),
        (2, 2, 0, '', []), (2, 3, 3, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 3, 'I', ['user:'])),
edit(st, ini, letter, nst, k, role) AS (VALUES (0, 's', 'K', 1, 0, NULL), (0, 'u', 'K', 2, 0, NULL), (1, 'u', 'K', 2, 0, NULL), (2, 'a', 'K', 3, 0, NULL), (3, 'u', 'K', 2, 0, NULL),
        (0, NULL, 'R', 2, 3, 'user'), (1, NULL, 'R', 2, 3, 'user'), (2, NULL, 'R', 3, 3, 'assistant'), (3, NULL, 'R', 2, 3, 'user'),
        (0, NULL, 'D', 0, 4, NULL), (1, NULL, 'D', 1, 4, NULL), (2, NULL, 'D', 2, 4, NULL), (3, NULL, 'D', 3, 4, NULL)),
p(c, i, st, cost, audit, said) AS (
  SELECT c, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM n
  UNION ALL
  SELECT c, i, st, cost, audit, said FROM (
    SELECT p.c, f.i, edit.nst AS st, p.cost + ins.k + edit.k + CASE WHEN fault = 't' AND letter <> 'D' THEN 3 ELSE 0 END AS cost, p.audit || ins.audit || letter AS audit,
           p.said || ins.said || CASE WHEN letter = 'D' THEN [] ELSE [coalesce(edit.role, f.role) || ':' || f.text] END AS said
    FROM p JOIN ins ON ins.st = p.st JOIN f ON f.c = p.c AND f.i = p.i + 1 JOIN edit ON edit.st = ins.nst AND (edit.ini IS NULL OR edit.ini = f.ini) AND (letter = 'D' OR fault NOT IN ('b', 'd'))
    QUALIFY row_number() OVER (PARTITION BY p.c, edit.nst ORDER BY p.cost + ins.k + edit.k + CASE WHEN fault = 't' AND letter <> 'D' THEN 3 ELSE 0 END, p.audit || ins.audit || letter) = 1)),
e AS (SELECT p.c, p.cost + ins.k AS cost, p.audit || ins.audit AS audit, p.said || ins.said AS said FROM p JOIN n ON n.c = p.c AND n.rows = p.i JOIN ins ON ins.st = p.st AND ins.nst IN (0, 3)
      QUALIFY row_number() OVER (PARTITION BY p.c ORDER BY p.cost + ins.k, p.audit || ins.audit) = 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM c) LEFT JOIN n USING (c) LEFT JOIN e USING (c)
"""

ORACLES["op12_conversation_repair"] = OP12

OP13 = """
WITH p AS (SELECT page_id, row_number() OVER () AS r, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT *, first_value(page_id) OVER w AS top, first_value(r) OVER w AS top_row FROM p WINDOW w AS (PARTITION BY hex ORDER BY page_id DESC NULLS LAST, r)),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST('0x' || substr(hex, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN r = top_row THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r <> top_row THEN top END AS refers_to FROM b
"""

ORACLES["op13_warc"] = OP13
