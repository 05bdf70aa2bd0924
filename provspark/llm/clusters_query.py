"""Query of centroid clustering: 40 clusters of all embeddings after 5 rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provspark.llm.centroids import cluster, with_inertia
from provspark.llm.common import table
from provspark.llm.registry import query

K, ROUNDS, DIMS = 40, 5, 64


def _sql() -> str:
    """Vectors and centroids as rows per component; each round is a step of its own."""
    steps = [f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, unnest(range({DIMS})) AS i, unnest(v) AS x FROM v),
s AS (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS INTEGER) AS k, v FROM v WHERE vec_id IS NOT NULL),
c0 AS MATERIALIZED (SELECT k, unnest(range({DIMS})) AS i, unnest(v) AS y FROM s WHERE k < {K})"""]
    for n in range(ROUNDS + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (SELECT r, min({{'d': d, 'k': k}}) AS best FROM
    (SELECT r, k, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM x JOIN c{n} USING (i) GROUP BY r, k) GROUP BY r)""")
        if n < ROUNDS:
            steps.append(f"""
m{n} AS (SELECT best.k AS k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN x USING (r) GROUP BY 1, 2),
c{n + 1} AS MATERIALIZED (SELECT c.k, c.i, CASE WHEN m.n IS NULL THEN c.y ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS y
    FROM c{n} c LEFT JOIN m{n} m ON c.k = m.k AND c.i = m.i)""")
    return ",".join(steps) + f""",
h AS (SELECT k, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, best.k AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM v JOIN a{ROUNDS} USING (r) JOIN h ON h.k = best.k
"""


@query("op13_centroids", _sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), K, ROUNDS, DIMS))
