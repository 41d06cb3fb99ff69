"""The n-gram Jaccard join in SQL, by all shared shingles: for small tables."""

from __future__ import annotations

SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x09-\x0D\x20]+') AS w
  FROM documents),
sets AS (
  SELECT k, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                         ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS g
  FROM words),
shingles AS (SELECT k, unnest(g) AS x FROM sets),
shared AS (SELECT a.k AS a, b.k AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.x = b.x AND a.k <> b.k GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sets x ON x.k = a JOIN sets y ON y.k = b
  WHERE 100 * n >= 80 * (len(x.g) + len(y.g) - n)),
reach(k, other) AS (SELECT k, k FROM sets UNION SELECT reach.k, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM sets s JOIN reach r ON r.k = s.k JOIN sets o ON o.k = r.other
GROUP BY s.k, s.doc_id, s.g
"""
