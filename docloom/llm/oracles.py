"""DuckDB SQL for the queries whose whole result SQL can state."""

from __future__ import annotations

#: Least reachable node over links (a, b), both ways, among nodes (n).
_COMPONENTS = """reach AS (SELECT n AS node, n AS seen FROM nodes UNION SELECT r.node, l.b FROM reach r JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) l ON l.a = r.seen),
comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)"""

#: Rows of (vec_id, x, label) that can be used; x: floor(factor * component), in double precision.
_FLOORS = """SELECT vec_id, label, list_transform(embedding, lambda c: floor({factor} * CAST(c AS DOUBLE))) AS x FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"""


def _rounds(rounds: int) -> str:
    """Lloyd's rounds over parts (vec_id, part, x) from entries e0 (part, entry, x)."""
    out = []
    for k in range(rounds + 1):
        out.append(f"""a{k} AS MATERIALIZED (SELECT p.vec_id, p.part, arg_min(e.entry, struct_pack(d := p.n + e.n - 2 * list_dot_product(p.x, e.x), k := e.entry)) AS entry,
  min(p.n + e.n - 2 * list_dot_product(p.x, e.x)) AS error FROM parts p JOIN e{k} e ON e.part = p.part GROUP BY p.vec_id, p.part)""")
        if k < rounds:
            out.append(f"""c{k} AS (SELECT part, entry, list(v ORDER BY i) AS x FROM (
  SELECT a.part, a.entry, i, floor(sum(p.x[i]) / count(*)) AS v FROM a{k} a JOIN parts p ON p.vec_id = a.vec_id AND p.part = a.part, range(1, 1 + (SELECT max(len(x)) FROM parts)) r(i) GROUP BY ALL) GROUP BY part, entry),
e{k + 1} AS MATERIALIZED (SELECT part, entry, x, list_dot_product(x, x) AS n FROM (SELECT e.part, e.entry, coalesce(c.x, e.x) AS x FROM e{k} e LEFT JOIN c{k} c ON c.part = e.part AND c.entry = e.entry))""")
    return ",\n".join(out)


ORACLE_SQL = {
    "op4_minhash_dedup": f"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (
  SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle FROM w)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN z u ON u.doc_id = a JOIN z v ON v.doc_id = b WHERE 100 * shared >= 80 * (u.n + v.n - shared)),
nodes AS (SELECT DISTINCT doc_id AS n FROM documents),
{_COMPONENTS}
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN comp c ON c.node = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id""",
    "op5_embedding_dedup": f"""WITH RECURSIVE
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM e p JOIN e q ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.98),
deg AS (SELECT v, count(*) AS n FROM (SELECT a AS v FROM links UNION ALL SELECT b FROM links) GROUP BY v),
nodes AS (SELECT DISTINCT vec_id AS n FROM embeddings),
{_COMPONENTS}
SELECT m.vec_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m JOIN comp c ON c.node = m.vec_id LEFT JOIN deg ON deg.v = m.vec_id""",
    "op11_hard_negatives": f"""WITH f AS ({_FLOORS.format(factor=256)}),
r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, x FROM f WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM r a JOIN r b ON b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op13_vector_codes": f"""WITH f AS ({_FLOORS.format(factor=1024)}),
parts AS MATERIALIZED (SELECT vec_id, part, x, list_dot_product(x, x) AS n FROM (
  SELECT vec_id, CAST(part AS INTEGER) AS part, x[CAST(part * len(x) / 4 AS BIGINT) + 1:CAST((part + 1) * len(x) / 4 AS BIGINT)] AS x FROM f, range(4) t(part))),
e0 AS MATERIALIZED (SELECT part, CAST(k - 1 AS INTEGER) AS entry, x, n FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS k FROM parts) WHERE k <= 256),
{_rounds(4)},
v AS (SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM a4 GROUP BY vec_id),
w AS (SELECT f.vec_id, f.label, v.code, v.error FROM f JOIN v ON v.vec_id = f.vec_id),
books AS (SELECT sha256(string_agg(t, ',' ORDER BY part, entry)) AS seal FROM (SELECT part, entry, array_to_string(list_transform(x, lambda c: CAST(CAST(c AS BIGINT) AS VARCHAR)), ',') AS t FROM e4))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, seal AS codebooks_sha256 FROM w, books""",
}
