"""SQL of the queries that SQL can express, for DuckDB."""

NEGATIVES = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""


def _part(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_part(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, leaves: str) -> str:
    return f"""{name} AS (
  {leaves}
  UNION ALL
  SELECT any_value(level) + 1, tree, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, pos // 3
)"""


#: The CRC-32 of a decimal number, bit by bit: the polynomial is a fixed value.
_BIT = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"

MANIFEST = f"""
WITH RECURSIVE bytes AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL
), crc AS (
  SELECT doc_id, s, 0 AS done, 8 AS bits, CAST(4294967295 AS BIGINT) AS c FROM bytes
  UNION ALL
  SELECT doc_id, s, CASE WHEN bits = 8 THEN done + 1 ELSE done END, CASE WHEN bits = 8 THEN 0 ELSE bits + 1 END,
    CASE WHEN bits = 8 THEN xor(c, CAST(ord(substr(s, done + 1, 1)) AS BIGINT)) ELSE {_BIT} END
  FROM crc WHERE done < length(s) OR bits < 8
), even AS (
  SELECT doc_id, xor(c, 4294967295) % 2 = 0 AS hit FROM crc WHERE done = length(s) AND bits = 8
), leaves AS (
  SELECT doc_id, {_leaf("text")} AS leaf, CASE WHEN coalesce(hit, false) THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS tampered,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, source
  FROM documents LEFT JOIN even USING (doc_id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), {_levels("nodes", "SELECT 0 AS level, tree, pos, n, leaf AS digest FROM placed")}, heads AS (
  SELECT tree, digest FROM nodes WHERE n = 1
), {_levels("crown", "SELECT 0 AS level, 0 AS tree, tree AS pos, count(*) OVER () AS n, digest FROM heads")}, steps AS (
  SELECT d.tree, d.pos, u.level, coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (WHERE u.pos < d.pos // CAST(3 ** u.level AS BIGINT)), '') AS l,
    coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (WHERE u.pos > d.pos // CAST(3 ** u.level AS BIGINT)), '') AS r
  FROM placed d JOIN nodes u ON u.tree = d.tree AND u.n > 1 AND u.pos // 3 = d.pos // CAST(3 ** (u.level + 1) AS BIGINT) GROUP BY ALL
  UNION ALL
  SELECT d.tree, d.pos, 1000 + u.level, coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (WHERE u.pos < d.tree // CAST(3 ** u.level AS BIGINT)), '') AS l,
    coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (WHERE u.pos > d.tree // CAST(3 ** u.level AS BIGINT)), '') AS r
  FROM placed d JOIN crown u ON u.n > 1 AND u.pos // 3 = d.tree // CAST(3 ** (u.level + 1) AS BIGINT) GROUP BY ALL
), ways AS (
  SELECT tree, pos, list({{'level': level, 'l': l, 'r': r}} ORDER BY level) AS way FROM steps GROUP BY tree, pos
), folded AS (
  SELECT tree, pos, 0 AS step, tampered AS acc FROM placed
  UNION ALL
  SELECT f.tree, f.pos, f.step + 1, sha256(way[f.step + 1].l || f.acc || way[f.step + 1].r) FROM folded f JOIN ways USING (tree, pos) WHERE f.step < len(way)
), tops AS (
  SELECT tree, pos, max_by(acc, step) AS folded_root FROM folded GROUP BY tree, pos
)
SELECT p.doc_id, p.leaf, h.digest AS subroot, c.digest AS root, sha256(coalesce(array_to_string([s.l || s.r FOR s IN way], ''), '')) AS proof_sha256,
  folded_root, folded_root = c.digest AS verified
FROM placed p JOIN heads h USING (tree) JOIN tops USING (tree, pos) LEFT JOIN ways USING (tree, pos) JOIN crown c ON c.n = 1
"""

ORACLE = {"op12_hard_negatives": NEGATIVES, "op13_merkle_manifest": MANIFEST}
