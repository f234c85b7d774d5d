"""DuckDB SQL of the corpus queries that SQL can express."""

FILL_IN_MIDDLE = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
hashed AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
         CAST(('0x' || h[1:8]) AS BIGINT) AS h1, CAST(('0x' || h[9:16]) AS BIGINT) AS h2, CAST(('0x' || h[17:24]) AS BIGINT) AS h3, CAST(('0x' || h[25:32]) AS BIGINT) AS h4
  FROM base),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed),
parts AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

SUBSTRING_DEDUP = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT r, doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM texts WHERE doc_id IS NOT NULL),
windows AS (SELECT r, doc_id, i, array_to_string(words[i:i + 12], ' ') AS w FROM starts),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
covered AS (SELECT DISTINCT r, i + k AS p FROM windows JOIN firsts USING (w), (SELECT unnest(range(13)) AS k) WHERE first < doc_id),
places AS (SELECT r, words, unnest(range(1, len(words) + 1)) AS p FROM texts),
kept AS (SELECT r, string_agg(words[p], ' ' ORDER BY p) AS text, count(*) AS n FROM places ANTI JOIN covered USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""

MERKLE_MANIFEST = r"""
WITH RECURSIVE
coded AS (
  SELECT doc_id, lang, n_chars, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail, CAST(doc_id AS VARCHAR) AS id
  FROM documents),
summed AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(id) + 1), lambda i: CAST(ascii(id[i]) AS BIGINT))),
                            lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc
  FROM coded),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen(CAST(n_chars + bump AS VARCHAR)) || ':' || (n_chars + bump), '-') || tail) AS other
  FROM (SELECT *, CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS bump FROM summed)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM leaves),
nodes AS (
  SELECT g, 0 AS lvl, idx, n, leaf AS d FROM ranked
  UNION ALL
  SELECT g, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY g, lvl, n, idx // 2),
groups AS (SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
crown AS (
  SELECT 0 AS lvl, idx, n, d FROM groups
  UNION ALL
  SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY idx)) FROM crown WHERE n > 1 GROUP BY lvl, n, idx // 2),
steps AS (
  SELECT r.g, r.idx, a.lvl AS pos, a.idx % 2 = 1 AS turned, b.d
  FROM ranked r JOIN nodes a ON a.g = r.g AND a.n > 1 AND a.idx = r.idx >> a.lvl LEFT JOIN nodes b ON b.g = a.g AND b.lvl = a.lvl AND b.idx = xor(a.idx, 1)
  UNION ALL
  SELECT r.g, r.idx, 100 + a.lvl, a.idx % 2 = 1, b.d
  FROM ranked r JOIN groups q ON q.g = r.g JOIN crown a ON a.n > 1 AND a.idx = q.idx >> a.lvl LEFT JOIN crown b ON b.lvl = a.lvl AND b.idx = xor(a.idx, 1)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g, idx ORDER BY pos) AS k FROM steps),
proofs AS (SELECT g, idx, string_agg(d, '' ORDER BY pos) AS proof FROM steps GROUP BY g, idx),
folded AS (
  SELECT g, idx, 0 AS k, other AS d FROM ranked
  UNION ALL
  SELECT f.g, f.idx, f.k + 1, CASE WHEN s.d IS NULL THEN sha256(f.d) WHEN s.turned THEN sha256(s.d || f.d) ELSE sha256(f.d || s.d) END
  FROM folded f JOIN numbered s ON s.g = f.g AND s.idx = f.idx AND s.k = f.k + 1),
ends AS (SELECT g, idx, arg_max(d, k) AS d FROM folded GROUP BY g, idx)
SELECT r.doc_id, r.leaf, q.d AS subroot, c.d AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.d AS folded_root, e.d = c.d AS verified
FROM ranked r JOIN groups q ON q.g = r.g JOIN crown c ON c.n = 1 LEFT JOIN proofs p ON p.g = r.g AND p.idx = r.idx JOIN ends e ON e.g = r.g AND e.idx = r.idx
"""
