"""SQL twins of the queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_line_dedup"] = r"""
WITH docs AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND text <> ''
), lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM docs
), told AS (
  SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS held FROM lines
), placed AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, i) + dense_rank() OVER (ORDER BY doc_id) AS place FROM told WHERE held
), pairs AS (
  SELECT a.place AS p, b.place AS q FROM placed a JOIN placed b ON a.line = b.line AND a.place < b.place
), islands AS (
  SELECT p, q, q - p AS d, p - row_number() OVER (PARTITION BY q - p ORDER BY p) AS island FROM pairs
), runs AS (
  SELECT d, min(p) AS p0, max(p) AS p1, count(*) AS n FROM islands GROUP BY d, island
), deleted AS (
  SELECT DISTINCT unnest(range(p0 + d, p1 + d + 1)) AS place FROM runs
), longest AS (
  SELECT place, max(n) AS n FROM (SELECT p0 AS place, n FROM runs UNION ALL SELECT p0 + d, n FROM runs) GROUP BY place
), marked AS (
  SELECT t.doc_id, t.i, t.line, CASE WHEN t.held THEN x.place IS NOT NULL END AS gone, l.n
  FROM told t LEFT JOIN placed p USING (doc_id, i) LEFT JOIN deleted x USING (place) LEFT JOIN longest l USING (place)
), decided AS (
  SELECT *, coalesce(
    last_value(gone IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING),
    first_value(gone IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    false) AS goes
  FROM marked
), counted AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_deleted, max(n) AS longest_run,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '') AS kept
  FROM decided GROUP BY doc_id
)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_deleted, 0) AS n_deleted, coalesce(c.longest_run, 0) AS longest_run,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(c.kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN counted c USING (doc_id)
"""

ORACLES["op2_shard"] = r"""
WITH table_of AS (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
  FROM range(256) t(i)
), crc AS (SELECT list(c ORDER BY i) AS t FROM table_of),
distinct_texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
bytes AS (SELECT text, hex(encode(text)) AS h FROM distinct_texts),
codes AS (
  SELECT text, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM bytes
), sums AS (
  SELECT text, xor(list_reduce(b, lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8), 4294967295), 4294967295) AS crc
  FROM codes, crc
), docs AS (
  SELECT d.doc_id, coalesce(strlen(d.text), 0) + 16 AS size, coalesce(s.crc, 0) AS text_crc32,
         coalesce('=' || source, '~') AS src, md5('17:' || coalesce(d.doc_id::VARCHAR, 'null')) AS digest
  FROM documents d LEFT JOIN sums s ON d.text = s.text
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY src ORDER BY digest, doc_id, text_crc32, size) - 1 + 0.5::DOUBLE)
            / count(*) OVER (PARTITION BY src) AS fraction FROM docs
), placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, src, digest, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM ranked
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (place * 40 // n)::INTEGER AS shard,
       (place - ((place * 40 // n) * n + 39) // 40)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""

ORACLES["op4_mix"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce('=' || source, '~') AS src,
         md5('29:' || coalesce(doc_id::VARCHAR, 'null')) AS digest FROM documents
), sources AS (
  SELECT src, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap,
         [3, 1, 2][(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS w FROM docs GROUP BY src
), before AS (
  SELECT *, (sum(source_size) OVER ()) * 1.5::DOUBLE AS budget, sum(w) OVER () AS all_w,
         coalesce(sum(cap) OVER o, 0) AS caps_before, coalesce(sum(w) OVER o, 0) AS w_before
  FROM sources WINDOW o AS (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
  SELECT *, w * ((budget - caps_before) / (all_w - w_before)) > cap AS full_up FROM before
), goals AS (
  SELECT src, source_size,
         CASE WHEN full_up THEN cap::DOUBLE
              ELSE w * (budget - sum(CASE WHEN full_up THEN cap ELSE 0 END) OVER ()) / (all_w - sum(CASE WHEN full_up THEN w ELSE 0 END) OVER ())
         END AS target FROM capped
), placed AS (
  SELECT d.*, g.source_size, g.target, floor(g.target)::BIGINT AS goal,
         coalesce(sum(size) OVER (PARTITION BY d.src ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begun
  FROM docs d JOIN goals g USING (src)
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, goal - begun)) + greatest(0, least(size, goal - source_size - begun)))::BIGINT AS taken
FROM placed
"""

ORACLES["op6_decontaminate"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), items AS (
  SELECT item_id::VARCHAR AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL
), starts AS (
  SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM items WHERE len(ws) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM starts
), lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM docs, lengths WHERE len(ws) >= n
), met AS (
  SELECT p.r, p.i, p.n, w.item_id FROM (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w FROM places) p
  JOIN windows w ON p.n = w.n AND p.w = w.w
), hits AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM met) GROUP BY r
), listed AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM met WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(l.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h USING (r) LEFT JOIN listed l USING (r)
"""

ORACLES["op9_partenum"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM docs WHERE len(ws) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs p JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS at, doc_id AS low FROM documents
  UNION SELECT b.y, r.low FROM reach r JOIN both_ways b ON b.x = r.at WHERE r.low < b.y
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, (SELECT min(low) FROM reach r WHERE r.at = d.doc_id) AS component_id
FROM docs d LEFT JOIN sizes s USING (doc_id)
"""

ORACLES["op11_prefix_trie"] = r"""
WITH table_of AS (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
  FROM range(256) t(i)
), crc AS (SELECT list(c ORDER BY i) AS t FROM table_of),
ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
shared AS (
  SELECT conv_id, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ord(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8)), 4294967295) % 4 AS h
  FROM ids, crc
), seqs AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS s FROM conversations GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.s[1:h], []), c.s[h + 1:]) AS s
  FROM seqs c JOIN shared USING (conv_id) LEFT JOIN seqs b ON b.conv_id = c.conv_id - c.conv_id % 20
), prefixes AS (
  SELECT conv_id, d, len(s) AS n, sha256(to_json(s[1:d])::VARCHAR) AS key, sha256(to_json(s[1:d - 1])::VARCHAR) AS above,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(s[d].t, '[^\x20\x09-\x0D]+')) END AS words
  FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, max(above) AS above,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = n), '')) AS ends_sha256
  FROM prefixes GROUP BY d, key
), children AS (SELECT above AS key, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT p.d, p.key, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum((o.n_convs - 1) * o.words) AS saved
  FROM nodes o LEFT JOIN children c ON c.key = o.key AND c.d = o.d JOIN prefixes p ON p.conv_id = o.conv_id AND p.d <= o.d
  GROUP BY p.d, p.key
)
SELECT o.conv_id, o.d AS depth, u.conv_id AS parent_conv_id, o.n_convs, coalesce(c.n, 0) AS n_children, b.n_leaves,
  b.saved::BIGINT AS saved_tokens, o.ends_sha256
FROM nodes o JOIN below b ON b.d = o.d AND b.key = o.key
LEFT JOIN children c ON c.d = o.d AND c.key = o.key LEFT JOIN nodes u ON u.d = o.d - 1 AND u.key = o.above
"""

ORACLES["op13_fill_middle"] = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS x FROM documents
), cut AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS ls, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2,
    ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4
  FROM drawn
), placed AS (
  SELECT *, len(ls) AS n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT *, array_to_string(ls[1:a], '') AS p, array_to_string(ls[a + 1:b], '') AS m, array_to_string(ls[b + 1:], '') AS s FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256
FROM parts
"""
