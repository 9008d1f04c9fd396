"""DuckDB SQL of the text operators that SQL can express."""

MANIFEST = """
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS entries FROM (SELECT cast(i AS BIGINT) AS i FROM range(256) r(i))),
docs AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, text, coalesce(strlen(cast(doc_id AS varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
  || coalesce(strlen(cast(n_chars AS varchar)) || ':' || n_chars, '-') AS head,
  list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id AS varchar), ''), lambda x: cast(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, entries[cast(xor(c, b) & 255 AS integer) + 1])) AS crc
  FROM documents, crc_table),
hashed AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS forged FROM docs),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM hashed),
low AS (
  SELECT g, 0 AS k, i, n, leaf AS d FROM leaves
  UNION ALL SELECT g, k + 1, i // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY g, k, i // 16, n),
low_runs AS (SELECT g, k, i // 16 AS up, list(d ORDER BY i) AS run FROM low GROUP BY g, k, i // 16),
subroots AS (SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS k, i, n, d FROM subroots
  UNION ALL SELECT k + 1, i // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY k, i // 16, n),
high_runs AS (SELECT k, i // 16 AS up, list(d ORDER BY i) AS run FROM high GROUP BY k, i // 16),
walk AS (
  SELECT g, doc_id, leaf, 0 AS k, i AS place, i, n, coalesce(forged, leaf) AS folded, '' AS proof FROM leaves
  UNION ALL SELECT w.g, doc_id, leaf, w.k + 1, place, i // 16, (n + 15) // 16, sha256(array_to_string(run[:i % 16], '') || folded || array_to_string(run[i % 16 + 2:], '')),
  proof || array_to_string(run[:i % 16], '') || array_to_string(run[i % 16 + 2:], '') FROM walk w JOIN low_runs r ON r.g = w.g AND r.k = w.k AND r.up = i // 16 WHERE n > 1),
on_top AS (
  SELECT w.g, doc_id, leaf, place, s.d AS subroot, 0 AS k, s.i, s.n, folded, proof FROM walk w JOIN subroots s ON s.g = w.g WHERE w.n = 1
  UNION ALL SELECT w.g, doc_id, leaf, place, subroot, w.k + 1, i // 16, (n + 15) // 16, sha256(array_to_string(run[:i % 16], '') || folded || array_to_string(run[i % 16 + 2:], '')),
  proof || array_to_string(run[:i % 16], '') || array_to_string(run[i % 16 + 2:], '') FROM on_top w JOIN high_runs r ON r.k = w.k AND r.up = i // 16 WHERE n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM on_top, (SELECT d AS root FROM high WHERE n = 1) WHERE n = 1
"""
