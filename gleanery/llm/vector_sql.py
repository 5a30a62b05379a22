"""SQL for the queries on embeddings."""

from __future__ import annotations

_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP11_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / a.size / b.size >= 0.9),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r(n, c) USING KEY (n) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, min(r.c) FROM r JOIN l ON l.a = r.n JOIN recurring.r AS o ON o.n = l.b WHERE r.c < o.c GROUP BY l.b)
SELECT vec_id, coalesce(n.n, 0) AS n_links, r.c AS component_id, vec_id = r.c AS kept FROM embeddings JOIN r ON r.n = vec_id LEFT JOIN n ON n.a = vec_id
"""

OP12_SQL = f"""
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
           FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.*, other AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def _rounds(n: int) -> str:
    """Lloyd's rounds: a<r> the nearest centroids, as distance * 8 + number; c<r+1> the centroids after them."""
    out = []
    for r in range(n + 1):
        distance = "list_sum(list_transform(generate_series(1, 64), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])))"
        out.append(f"a{r} AS MATERIALIZED (SELECT v.vec_id, any_value(v.e) AS e, min(CAST({distance} AS BIGINT) * 8 + c.c) AS m FROM v, c{r} AS c GROUP BY v.vec_id)")
        if r < n:
            parts = f"SELECT m % 8 AS c, i, CAST(sum(e[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, generate_series(1, 64) AS g(i) GROUP BY 1, 2"
            new = f"SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM ({parts}) GROUP BY c"
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(w.e, o.e) AS e FROM c{r} o LEFT JOIN ({new}) w ON w.c = o.c)")
    return ",\n".join(out)


OP13_SQL = f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, e FROM (SELECT sha256('3:' || vec_id) AS h, e FROM v ORDER BY h LIMIT 8)),
{_rounds(10)},
f AS (SELECT vec_id, CAST(m % 8 AS INTEGER) AS cluster, m // 8 AS distance FROM a10)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c10.e, ',')) AS centroid_sha256
FROM f JOIN c10 ON c10.c = f.cluster
"""
