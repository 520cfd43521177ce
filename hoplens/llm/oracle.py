"""DuckDB SQL of the training-data queries that SQL can express."""

_DIGITS = "sha1(coalesce(html, ''))"
_HEX = "(strpos('0123456789abcdef', substr(s, {}, 1)) - 1)"
_BASE32 = ("array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
           "(((({} * 16 + {}) >> (3 - (5 * i) % 4)) & 31) + 1)::INT, 1)), '')").format(
    _HEX.format("(5 * i) // 4 + 1"), _HEX.format("(5 * i) // 4 + 2"))

SQL = {
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
   AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (
  SELECT vec_id AS a, vec_id AS c FROM embeddings
  UNION SELECT r.a, l.b FROM r JOIN l ON r.c = l.a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = v.vec_id
JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) c ON c.a = v.vec_id
""",
    "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op8_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, coalesce(html, '') AS html,
                  {_DIGITS} AS s, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS low FROM pages)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to
FROM p
""",
}
