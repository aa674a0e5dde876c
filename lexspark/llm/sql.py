"""DuckDB SQL of the training-data queries that SQL can say."""

from __future__ import annotations

from lexspark.llm.hadamard import CENTROIDS, ROUNDS, SCALE, SIZE, START
from lexspark.llm.lexical import K1, LENGTH_SHARE, TOP


def _clusters() -> str:
    """One pair of CTEs for each round: the nearest centroid of every vector, then the moved centroids."""
    nearest = (
        "near{i} AS MATERIALIZED (SELECT vec_id, r, v, min(d * 1000 + k) % 1000 AS k, min(d * 1000 + k) // 1000 AS d FROM ("
        "SELECT vec_id, r, v, k, list_sum(list_transform(range(1, {size} + 1), lambda j: (v[j] - c[j]) * (v[j] - c[j])))::BIGINT AS d "
        "FROM vectors, centre{i}) GROUP BY vec_id, r, v)"
    )
    moved = (
        "centre{n} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM centre{i} LEFT JOIN ("
        "SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM ("
        "SELECT k, j, sum(v[j])::BIGINT AS s, count(*)::BIGINT AS n FROM near{i}, range(1, {size} + 1) g(j) GROUP BY k, j) GROUP BY k) USING (k))"
    )
    ctes = [
        f"vectors AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v "
        f"FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE})",
        f"centre0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM ("
        f"SELECT sha256('{START}' || vec_id) AS h, v FROM vectors WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {CENTROIDS}))",
    ]
    for i in range(ROUNDS):
        ctes += [nearest.format(i=i, size=SIZE), moved.format(i=i, n=i + 1, size=SIZE)]
    ctes.append(nearest.format(i=ROUNDS, size=SIZE))
    return (
        f"WITH {', '.join(ctes)} SELECT vec_id, k::INTEGER AS cluster, d::BIGINT AS distance, "
        "sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, "
        f"sha256(array_to_string(c, ',')) AS centroid_sha256 FROM near{ROUNDS} JOIN centre{ROUNDS} USING (k)"
    )


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

_RANKED = f"""
WITH words AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
sizes AS MATERIALIZED (SELECT r, doc_id, len(t)::BIGINT AS n FROM words WHERE len(t) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
wanted AS MATERIALIZED (SELECT DISTINCT item_id, i, unnest(t) AS term FROM (SELECT item_id, row_number() OVER () AS i, {_TERMS} AS t FROM benchmark)),
held AS MATERIALIZED (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM words)
  WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM held GROUP BY term), total),
scored AS (SELECT i, item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + {K1} * (100 - {LENGTH_SHARE} + ({LENGTH_SHARE} * n * docs) // terms))))::BIGINT AS score
  FROM wanted JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (r), total GROUP BY i, item_id, doc_id, r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {TOP}"""

SQL = {"op13_progressive_clusters": _clusters(), "op12_bag_ranking": _RANKED}
