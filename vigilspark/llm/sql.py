"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_COMPONENTS = """
    reach(node, other) AS (
        SELECT node, node FROM nodes
        UNION
        SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
    )"""

OP2 = rf"""
WITH RECURSIVE
  tok AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda w: w <> '') AS w
    FROM documents),
  shingles AS (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
      WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s
    FROM tok),
  sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
  hashed AS (SELECT doc_id, s FROM shingles),
  common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM hashed x JOIN hashed y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
  nodes AS (SELECT DISTINCT a AS node FROM links), {_COMPONENTS},
  components AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN components c ON c.node = d.doc_id
"""

OP3 = r"""
WITH
  low(kind, id, t) AS (
    SELECT 0, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM documents
    UNION ALL
    SELECT 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
  tok AS (SELECT kind, id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM low),
  items AS (
    SELECT id AS item_id, least(13, len(w)) AS k,
      unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS s
    FROM tok WHERE kind = 1 AND len(w) > 0),
  lengths AS (SELECT DISTINCT k FROM items),
  windows AS (
    SELECT id AS doc_id, k, unnest(range(1, len(w) - k + 2)) AS p,
      unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
    FROM tok, lengths WHERE kind = 0 AND len(w) >= k),
  hits AS (SELECT doc_id, windows.k, p, item_id FROM windows JOIN items ON items.s = windows.s AND items.k = windows.k),
  hit_words AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
  hit_items AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT t.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
  sha256(coalesce(i.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM tok t LEFT JOIN hit_words h ON h.doc_id = t.id LEFT JOIN hit_items i ON i.doc_id = t.id WHERE kind = 0
"""

OP4 = rf"""
WITH RECURSIVE
  sound AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
    WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
  nodes AS (SELECT DISTINCT a AS node FROM links), {_COMPONENTS},
  components AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
  counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings e LEFT JOIN counts ON a = vec_id LEFT JOIN components ON node = vec_id
"""

ORACLES = {"op4_embeddings": OP4, "op3_decontaminate": OP3, "op2_minhash": OP2}
