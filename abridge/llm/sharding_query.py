"""Query of stratified sharding and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from abridge.llm.common import table
from abridge.llm.sharding import stratified_shards


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_shards(table(spark, sf_dir, "documents"), shards=40, seed=17)


#: DuckDB has no crc32; it is folded here over the hexadecimal digits of the text, two at a time.
SQL = r"""
WITH steps AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::UBIGINT] || list_transform(range(8), lambda k: 0::UBIGINT),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
hexed AS (SELECT doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (
  SELECT doc_id, source, strlen(text) + 16 AS size,
    xor(list_reduce([4294967295::UBIGINT] || list_transform(range(strlen(text)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT),
      lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS crc
  FROM hexed, steps),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id, crc) AS r, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT *, md5('17:' || coalesce(doc_id::VARCHAR, 'null:' || crc || ':' || (size - 16))) AS key, ('0x' || substr(md5('17:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS h FROM sums)),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (r - h) / n, source, key, doc_id, crc) - 1 AS spot, count(*) OVER () AS m FROM ranked)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, (spot * 40 // m)::INT AS shard,
  (spot - ((spot * 40 // m) * m + 39) // 40)::BIGINT AS slot, NULL::INT AS grown_shard
FROM placed
"""
