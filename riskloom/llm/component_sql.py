"""SQL twins of the two component queries: all linked pairs, then what is reachable over them."""

from __future__ import annotations

_REACH = """reach(a, b) AS (
  SELECT a, b FROM linked UNION SELECT reach.a, linked.b FROM reach JOIN linked ON reach.b = linked.a
), roots AS (SELECT a, least(a, min(b)) AS root FROM reach GROUP BY a)"""

JACCARD_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n AS n, y.n AS m, count(*) AS c
  FROM tokens x JOIN tokens y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL
), linked AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (n + m - c)),
{_REACH}
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id
FROM sets LEFT JOIN roots ON doc_id = a
"""

EMBEDDING_SQL = f"""
WITH RECURSIVE valid AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)) > 0
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), linked AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM valid x JOIN valid y
    ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.95
), {_REACH}, counts AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept
FROM embeddings LEFT JOIN counts c ON vec_id = c.a LEFT JOIN roots r ON vec_id = r.a
"""
