"""DuckDB SQL of the queries that SQL can express.

The token files, the packing, the fitted classifier, the balanced sample and the
tagger have no SQL; tests hold those against brute-force versions.
"""

from tickloom.llm.chat import CHAT_SQL

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.v, v.v) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.v) = len(v.v)
  WHERE q.vec_id % 20 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

LINES = """
WITH every AS (
  SELECT d.doc_id, t.pos, t.line, len(regexp_extract_all(t.line, '[^\\x20\\x09-\\x0D]+')) AS w
  FROM documents d, unnest(string_split(coalesce(d.text, ''), chr(10))) WITH ORDINALITY AS t(line, pos)),
l AS (
  SELECT doc_id, pos, line, w, row_number() OVER o AS i
  FROM every WHERE w > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
n AS (
  SELECT *, lead(line, 1) OVER o AS l1, lead(line, 2) OVER o AS l2, lead(w, 1) OVER o AS w1,
         lag(line, 1) OVER o AS p1, lag(line, 2) OVER o AS p2, lag(w, 1) OVER o AS v1
  FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (
  SELECT doc_id, i AS s, i AS e, line AS gram FROM n WHERE w >= 50
  UNION
  SELECT doc_id, i, i + 1, line || chr(10) || l1 FROM n WHERE w < 50 AND w + w1 >= 50
  UNION
  SELECT doc_id, i - 1, i, p1 || chr(10) || line FROM n WHERE w < 50 AND w + v1 >= 50
  UNION
  SELECT doc_id, i, i + 2, line || chr(10) || l1 || chr(10) || l2 FROM n WHERE w + w1 < 50 AND l2 IS NOT NULL
  UNION
  SELECT doc_id, i - 2, i, p2 || chr(10) || p1 || chr(10) || line FROM n WHERE w + v1 < 50 AND p2 IS NOT NULL),
o AS (
  SELECT doc_id, s, e, row_number() OVER (PARTITION BY gram ORDER BY doc_id, s, e) AS nth FROM g),
dead AS (SELECT DISTINCT l.doc_id, l.pos FROM o JOIN l ON l.doc_id = o.doc_id AND l.i BETWEEN o.s AND o.e WHERE o.nth > 1)
SELECT e.doc_id, count(*) FILTER (WHERE e.w > 0) AS n_lines, count(d.pos) AS n_removed,
       md5(coalesce(string_agg(e.line, chr(10) ORDER BY e.pos) FILTER (WHERE d.pos IS NULL), '')) AS text_md5
FROM every e LEFT JOIN dead d ON d.doc_id = e.doc_id AND d.pos = e.pos
GROUP BY e.doc_id
"""

COSINE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) >= 0.9 * sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))),
r AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION
  SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN k ON k.a = vec_id
"""

JACCARD = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""

# Windows as hex digits, two a byte, cut out of blocks of 1000 bytes and the 49 after them.
BYTES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (
  SELECT r, doc_id, CAST(t.o AS BIGINT) AS o, substr(x, 2 * t.o + 1, 2 * 1049) AS x
  FROM d, unnest(range(0, length(x) // 2, 1000)) AS t(o)),
w AS (
  SELECT r, doc_id, o + t.i AS pos, substr(x, 2 * t.i + 1, 100) AS w
  FROM b, unnest(range(0, least(1000, length(x) // 2 - 49))) AS t(i)),
f AS (SELECT w, min(doc_id) AS first FROM w GROUP BY w HAVING min(doc_id) < max(doc_id)),
g AS (SELECT r, pos AS s, pos + 50 AS e FROM w JOIN f USING (w) WHERE f.first < w.doc_id),
h AS (SELECT r, s, e, coalesce(s > max(e) OVER (PARTITION BY r ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM g),
i AS (SELECT r, s, e, count(*) FILTER (WHERE fresh) OVER (PARTITION BY r ORDER BY s) AS k FROM h),
p AS (SELECT r, min(s) AS s, max(e) AS e FROM i GROUP BY r, k),
l AS (SELECT r, list(s ORDER BY s) AS s, list(e ORDER BY s) AS e FROM p GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes,
       CAST(coalesce(list_sum(e) - list_sum(s), 0) AS BIGINT) AS n_removed,
       CAST(coalesce(len(s), 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN s IS NULL THEN x ELSE
         array_to_string(list_transform(list_zip(list_prepend(0, e), list_append(s, length(x) // 2)), lambda z: substr(x, CAST(2 * z[1] + 1 AS BIGINT), CAST(2 * (z[2] - z[1]) AS BIGINT))), '') END)) AS kept_sha256
FROM d LEFT JOIN l USING (r)
"""

FIM = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('7:' || doc_id) AS h FROM documents),
u AS (
  SELECT doc_id, x, regexp_extract_all(x, '[^\\n]*\\n|[^\\n]+') AS l,
         list_transform(range(4), lambda k: CAST('0x' || substr(h, CAST(8 * k + 1 AS BIGINT), 8) AS BIGINT)) AS h
  FROM t),
c AS (
  SELECT doc_id, x, CAST(len(l) AS BIGINT) AS n,
         CASE WHEN x = '' OR x LIKE '%<P>%' OR x LIKE '%<S>%' OR x LIKE '%<M>%' OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         list_transform([least(h[1] % (len(l) + 1), h[2] % (len(l) + 1)), greatest(h[1] % (len(l) + 1), h[2] % (len(l) + 1))], lambda k: CAST(coalesce(list_sum(list_transform(l[1:k], lambda z: length(z))), 0) AS BIGINT)) AS e
  FROM u)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN e[1] END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN e[2] - e[1] END AS middle_chars,
       sha256(CASE form
         WHEN 'plain' THEN x
         WHEN 'psm' THEN '<P>' || substr(x, 1, e[1]) || '<S>' || substr(x, e[2] + 1) || '<M>' || substr(x, e[1] + 1, e[2] - e[1])
         ELSE '<S>' || substr(x, e[2] + 1) || '<P>' || substr(x, 1, e[1]) || '<M>' || substr(x, e[1] + 1, e[2] - e[1]) END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM c
"""

# crc32 bit by bit; runs as islands of equal words p apart.
RUNS = """
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) AS h
  FROM documents),
a AS (SELECT *, CAST(len(w) AS BIGINT) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
o AS (
  SELECT r, n, CAST(t.i AS BIGINT) AS i, CASE WHEN t.i >= a THEN w[CAST(a + (t.i - a) % p + 1 AS BIGINT)] ELSE w[t.i + 1] END AS w
  FROM p, unnest(range(n)) AS t(i)),
e AS (SELECT x.r, y.i - x.i AS q, x.i FROM o x JOIN o y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM e),
m AS (SELECT r, q, min(i) AS s, count(*) + q AS n FROM s GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
u AS (SELECT r, s AS start, CAST(n AS BIGINT) AS length, CAST(min(q) AS BIGINT) AS period FROM m GROUP BY r, s, n),
c AS (SELECT r, count(*) AS n_runs, first({'s': start, 'n': length, 'q': period} ORDER BY length DESC, start, period) AS top,
             string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM u GROUP BY r),
x AS (SELECT DISTINCT r, CAST(t.i AS BIGINT) AS i FROM u, unnest(range(start + period, start + length)) AS t(i)),
k AS (SELECT o.r, string_agg(o.w, ' ' ORDER BY o.i) AS kept FROM o LEFT JOIN x ON x.r = o.r AND x.i = o.i WHERE x.i IS NULL GROUP BY o.r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, top.s AS start, top.n AS length, top.q AS period, 1000 * top.n // top.q AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN c USING (r) LEFT JOIN k USING (r)
"""

ORACLES = {
    "op1_vector_file_topk": TOPK,
    "op3_winnow_lines": LINES,
    "op4_pca_near_duplicates": COSINE,
    "op7_grouped_prefix_join": JACCARD,
    "op9_collapse_snapshots": CHAT_SQL,
    "op11_induced_suffix_dedup": BYTES,
    "op12_fill_in_middle": FIM,
    "op13_harmonic_runs": RUNS,
}
