"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

OP9 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)
), twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(t, '\P{Lu}+', '', 'g'))::BIGINT AS n_upper,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered c USING (doc_id)
), f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words) THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END)::BIGINT AS fail_mask
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_mask & 3) <> 0 AS base_failed, (fail_mask & 63) = 0 AS kept, fail_mask
FROM f
"""

OP2 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, replace(replace(coalesce(url, 'about:blank'), chr(13), '%0D'), chr(10), '%0A') AS uri FROM pages
), k AS (
  SELECT page_id, uri, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM k
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to, uri
FROM f
"""

OP4 = """
WITH n AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), r AS (
  SELECT source, n, pow(n::DOUBLE, 0.5) / (SELECT sum(pow(n::DOUBLE, 0.5)) FROM n) * (SELECT sum(n) FROM n)::DOUBLE / n AS rate FROM n
), steps AS (
  SELECT source, rate, unnest(range(0, 80)) AS k FROM r
), cdf AS (
  SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM steps
), u AS (
  SELECT doc_id, d.source, rate, text,
         ((('0x' || substr(md5('17|' || doc_id), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), drawn AS (
  SELECT doc_id, u.source, u.rate, text, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM u.source AND cdf.c < u.u) AS copies FROM u
), x AS (
  SELECT doc_id, source, rate, text, unnest(range(0, copies)) AS copy FROM drawn
)
SELECT doc_id, copy, source, rate, ('0x' || substr(md5('order17|' || doc_id || '|' || copy), 1, 15))::BIGINT AS shuffle_key, text FROM x
"""

OP5 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), link AS (
  SELECT o.a, o.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) o
  JOIN n p ON p.doc_id = o.a JOIN n q ON q.doc_id = o.b WHERE 100 * o.o >= 85 * (p.n + q.n - o.o)
), reach AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), c AS (
  SELECT a, min(least(a, b)) AS c FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""

OP7 = r"""
WITH RECURSIVE r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM r
), u AS (
  SELECT *, i = 1 AND role = 'system' AS sys,
         len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]')) + 3 AS n,
         length(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + 13 AS shown FROM t
), v AS (
  SELECT *, CASE WHEN sys THEN 0 ELSE n END AS tok, sum(n) OVER (PARTITION BY conv_id ORDER BY i) - n AS start,
         max(CASE WHEN sys THEN n ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_tok,
         max(CASE WHEN sys THEN shown ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_shown FROM u
), z AS (
  SELECT conv_id, i, tok AS used, 0 AS bucket, start // 16384 AS stretch FROM v WHERE i = 1
  UNION ALL
  SELECT conv_id, i, CASE WHEN opens THEN tok ELSE used + tok END, bucket + opens::INT, stretch FROM (
    SELECT v.conv_id, v.i, v.tok, z.used, z.bucket, v.start // 16384 AS stretch,
           v.start // 16384 <> z.stretch OR (z.used > 0 AND z.used + v.tok > greatest(1, 1024 - v.sys_tok - CASE WHEN z.bucket = 0 THEN 0 ELSE 192 END)) AS opens
    FROM z JOIN v ON v.conv_id IS NOT DISTINCT FROM z.conv_id AND v.i = z.i + 1)
), b AS (
  SELECT v.*, z.bucket FROM v JOIN z ON z.conv_id IS NOT DISTINCT FROM v.conv_id AND z.i = v.i
), g AS (
  SELECT conv_id, bucket, min(i) AS f, min(start) AS s, bool_or(sys) AS has_sys, max(sys_shown) AS sys_shown, sum(shown) AS own,
         least(192, greatest(0, 1024 - max(sys_tok) - sum(tok))) AS reach FROM b GROUP BY conv_id, bucket
), h AS (
  SELECT g.conv_id, g.bucket, sum(b.shown) AS past FROM g JOIN b ON b.conv_id IS NOT DISTINCT FROM g.conv_id
    AND NOT b.sys AND b.i < g.f AND b.start >= g.s - g.reach AND b.start < g.s GROUP BY 1, 2
), c AS (
  SELECT g.conv_id, sum(own + CASE WHEN has_sys THEN 0 ELSE g.sys_shown END + coalesce(past, 0))::BIGINT AS formatted_chars
  FROM g LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM g.conv_id AND h.bucket = g.bucket GROUP BY 1
), d AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '') AS loss FROM t GROUP BY 1
)
SELECT d.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM d JOIN c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
"""

OP8 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), c AS (
  SELECT a, min(least(a, b)) AS c FROM reach GROUP BY a
), n AS (
  SELECT a, count(*) AS n FROM link GROUP BY a
)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.c, vec_id) AS component_id, coalesce(c.c, vec_id) = vec_id AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""

OP9_ABLATION = f"""
WITH m AS (
  SELECT fail_mask::BIGINT AS f FROM ({OP9.strip()}) AS ledger
), r AS (
  SELECT unnest(['few_words', 'repeated_windows', 'symbols', 'duplicate_lines', 'word_length', 'shouting']) AS rule, unnest([1, 2, 4, 8, 16, 32])::BIGINT AS bit
)
SELECT rule, count(*) FILTER (f & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (f & 63 = bit)::BIGINT AS n_only_this,
       count(*) FILTER (f & (63 - bit) = 0)::BIGINT AS n_kept_without
FROM m CROSS JOIN r GROUP BY rule
"""

OP12 = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents) GROUP BY ALL
), bytes AS (
  SELECT w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM runs
), hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT)),
                               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM bytes, crc
), v AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS (
  SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole, substr(word, 1, i - 1) || substr(word, i + 1) AS less
  FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM v)
), pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT v.word, v.n, c.word, c.n FROM cut c JOIN v ON c.less = v.word
  UNION SELECT c.word, c.n, v.word, v.n FROM cut c JOIN v ON c.less = v.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM pairs GROUP BY word
), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END::BIGINT AS form_n
  FROM v LEFT JOIN best USING (word)
), walk AS (
  WITH RECURSIVE r AS (
    SELECT word, word AS last, form AS up FROM forms
    UNION ALL SELECT r.word, f.word, f.form FROM r JOIN forms f ON f.word = r.up
  ) SELECT word, last AS root FROM r WHERE up IS NULL
)
SELECT word, n, n_near, form, form_n, root FROM forms JOIN walk USING (word)
"""

OP13 = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), sized AS (
  SELECT conv_id, turns, (xor(list_reduce(list_prepend(4294967295, list_transform(range(length(conv_id::VARCHAR)), lambda i: unicode(substr(conv_id::VARCHAR, (i + 1)::INT, 1))::BIGINT)),
                                          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 4)::INT AS h
  FROM own, crc
), paths AS (
  SELECT s.conv_id, list_concat(coalesce(b.turns, [])[1:s.h], s.turns[s.h + 1:]) AS p
  FROM sized s LEFT JOIN own b ON b.conv_id = s.conv_id - ((s.conv_id % 20) + 20) % 20
), steps AS (
  SELECT conv_id, len(p) AS size, d, p[1:d] AS path, CASE WHEN d > 0 THEN p[1:d - 1] END AS up FROM (SELECT conv_id, p, unnest(range(0, len(p) + 1))::INT AS d FROM paths)
), nodes AS (
  SELECT path, up, d::BIGINT AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256,
         CASE WHEN d > 0 THEN (count(*) - 1) * len(regexp_extract_all(path[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS own_saved
  FROM steps GROUP BY path, up, d
), kids AS (
  SELECT up AS path, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up
), below AS (
  SELECT path[1:a] AS path, sum(own_saved)::BIGINT AS saved, count(*) FILTER (n IS NULL) AS leaves
  FROM (SELECT path, own_saved, n, unnest(range(0, depth + 1))::INT AS a FROM nodes LEFT JOIN kids USING (path)) GROUP BY 1
)
SELECT x.conv_id, x.depth, u.conv_id AS parent_conv_id, x.n_convs, coalesce(k.n, 0)::BIGINT AS n_children, b.leaves AS n_leaves, b.saved AS saved_tokens, x.ends_sha256
FROM nodes x JOIN below b USING (path) LEFT JOIN kids k USING (path) LEFT JOIN nodes u ON u.path = x.up
"""

ORACLES: dict[str, str] = {
    "op2_warc_transactions": OP2,
    "op4_poisson_mixing": OP4,
    "op5_ngram_jaccard_join": OP5,
    "op7_chat_windows": OP7,
    "op8_embedding_near_dedup": OP8,
    "op9_quality_ledger": OP9,
    "op9_quality_rule_ablation": OP9_ABLATION,
    "op12_spelling_variants": OP12,
    "op13_conversation_trie": OP13,
}
