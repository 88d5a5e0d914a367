"""Query of embedding near-dedup and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from abridge.llm.common import table
from abridge.llm.embedding_dedup import near_duplicate_vectors


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS r FROM embeddings UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.a),
n AS (SELECT a, count(*) AS k FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n.k, 0)::BIGINT AS n_links, min(reach.r) AS component_id, min(reach.r) = e.vec_id AS kept
FROM embeddings e JOIN reach ON reach.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id GROUP BY e.vec_id, n.k
"""
