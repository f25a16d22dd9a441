"""The queries that SQL can express on whole tables, for DuckDB."""

from __future__ import annotations

#: Words of a text: what stands between white space.
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: Bytes as hexadecimal digits, in pieces that overlap by a window less a byte; windows that occur twice, merged to spans.
OP1 = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
 n AS (SELECT doc_id, x, length(x) // 2 AS n FROM h),
 piece AS (SELECT doc_id, n, a, substr(x, 2 * a + 1, 4398) AS y FROM (SELECT doc_id, x, n, unnest(range(0, n, 2000)) AS a FROM n)),
 win AS (SELECT doc_id, unnest(list_transform(range(a, least(a + 2000, n - 199)), lambda i: {'i': i, 'k': md5(substr(y, 2 * (i - a) + 1, 400))})) AS w FROM piece WHERE a < n - 199),
 k AS (SELECT doc_id, w.i AS i, w.k AS k FROM win),
 f AS (SELECT doc_id, i FROM k SEMI JOIN (SELECT k FROM k GROUP BY k HAVING count(*) > 1) USING (k)),
 st AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 200 THEN 0 ELSE 1 END AS fresh FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 ru AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM st),
 span AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM ru GROUP BY doc_id, run),
 gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM span UNION ALL SELECT doc_id, max(b), NULL FROM span GROUP BY doc_id),
 kept AS (SELECT g.doc_id, string_agg(substr(x, 2 * lo + 1, 2 * (coalesce(hi, n) - lo)), '' ORDER BY lo) AS t FROM gap g JOIN n ON n.doc_id = g.doc_id GROUP BY g.doc_id),
 s AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans FROM span GROUP BY doc_id)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t, x))) AS kept_sha256
FROM n LEFT JOIN s ON s.doc_id = n.doc_id LEFT JOIN kept ON kept.doc_id = n.doc_id"""

#: Pairs of documents by shingles they share, then all that can be reached.
OP3 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace('coalesce(text', "translate(coalesce(text").replace("'')", "''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", 1)} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
 reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
 least_ AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_ ON least_.a = d.doc_id"""

#: Windows of 13 words, the smallest document of each, and words that no window of an earlier one covers.
OP8 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 k AS (SELECT doc_id, x.i AS i, x.s AS s FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: {{'i': i, 's': array_to_string(w[i:i + 12], ' ')}})) AS x FROM d WHERE len(w) >= 13)),
 hit AS (SELECT doc_id, i FROM k JOIN (SELECT s, min(doc_id) AS m FROM k GROUP BY s) f USING (s) WHERE m < doc_id),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit),
 one AS (SELECT doc_id, x.p AS p, x.w AS w FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) + 1), lambda i: {{'p': i, 'w': w[i]}})) AS x FROM d)),
 kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM one ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""
