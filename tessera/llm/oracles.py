"""DuckDB SQL of the training-data queries that SQL can express on whole tables.

The others are held against plain versions in tests/llm: 1 (an index finds most, not all), 2, 3 and 4 (fitted
models), 8 (cosines and path walks), 11 (eigenvectors), 12 (crc32), 10 and the pipeline (a tokenizer).
"""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ALNUM = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

REPEATS = f"""WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
 g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
 c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
 u AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS j FROM w),
 k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS kept, count(*) AS n FROM u WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = u.doc_id AND c.j = u.j) GROUP BY 1)
 SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""

SIMILARITY = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i+4], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
 e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
 r AS (SELECT x AS doc_id, x AS node FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.node)
 SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, min(node) AS c FROM r GROUP BY 1) m ON m.doc_id = w.doc_id"""

CHAT = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, v.turn, v.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
 f AS (SELECT *, CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 ELSE 25 + length(role) END + length(text) + length(text) - length(replace(text, '\', ''))
   + len(regexp_extract_all(text, '<<SYS>>|<</SYS>>|\[/?INST\]|</?s>|\[/?ROLE\]|\[/TURN\]')) AS size FROM t),
 c AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM f),
 k AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
   coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss,
   coalesce(sum(total) FILTER (role = 'assistant'), 0) + max(total) - coalesce(max(total) FILTER (role = 'assistant'), 0) AS formatted_chars FROM c GROUP BY 1)
 SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM k"""

CONTAMINATION = f"""WITH w AS (SELECT doc_id, {ALNUM.format(LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
 b AS (SELECT item_id, {ALNUM.format(LOWER.format("coalesce(text, '')"))} AS ws FROM benchmark),
 i AS (SELECT DISTINCT item_id, m, md5(array_to_string(ws[k:k+m-1], ' ')) AS h FROM (SELECT item_id, ws, least(10, len(ws)) AS m, unnest(range(1, greatest(len(ws) - 8, 2))) AS k FROM b WHERE len(ws) > 0)),
 g AS (SELECT doc_id, m, k, md5(array_to_string(ws[k:k+m-1], ' ')) AS h FROM (SELECT doc_id, m, ws, unnest(range(1, len(ws) - m + 2)) AS k FROM w, (SELECT DISTINCT m FROM i) WHERE len(ws) >= m)),
 x AS (SELECT doc_id, g.m, k, item_id FROM g JOIN i ON i.m = g.m AND i.h = g.h),
 hits AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(k, k + m)) AS j FROM x) GROUP BY 1),
 names AS (SELECT doc_id, count(*) AS n, string_agg(a, ',' ORDER BY a) AS a FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS a FROM x) GROUP BY 1)
 SELECT w.doc_id, len(ws) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(names.n, 0) AS n_items, sha256(coalesce(a, '')) AS items_sha256, hits.n IS NOT NULL AS contaminated
 FROM w LEFT JOIN hits ON hits.doc_id = w.doc_id LEFT JOIN names ON names.doc_id = w.doc_id"""

ARCHIVES = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
 m AS (SELECT *, CASE WHEN octet_length(b) >= 1000 THEN max(page_id) OVER (PARTITION BY b) ELSE page_id END AS top FROM p)
 SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest, CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to FROM m"""

ORACLES: dict[str, str] = {"op5_repeats": REPEATS, "op6_similarity": SIMILARITY, "op7_chat": CHAT, "op9_decontamination": CONTAMINATION, "op13_archives": ARCHIVES}
