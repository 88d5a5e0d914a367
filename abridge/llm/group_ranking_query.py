"""Query of ranks within groups of sale lines and its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abridge.llm.common import table
from abridge.llm.group_ranking import rank_in_groups


def op12_group_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = "coalesce(crc32(cast(sale_id as string)) % 5 = 0, false)"
    lines = table(spark, sf_dir, "sale_lines").selectExpr(
        f"if({one}, -1, cast(vendor_id as long)) AS vendor_id",
        f"if({one}, -1, coalesce(cast(item_id % 5 as long), -1)) AS part",
        f"if({one}, -1, coalesce(cast(100 * year(shipped_at) + month(shipped_at) as long), -1)) AS month",
        "floor(quantity / 10) AS tens",
        "cast(floor(100 * discount + 0.5) as long) AS percent",
        "cast(sale_id as long) AS sale_id", "cast(line_no as long) AS line_no", "cast(quantity as long) AS quantity",
        "cast(floor(100 * amount + 0.5) as long) AS amount_cents",
    )
    ranked = rank_in_groups(lines, ["vendor_id", "part", "month"], [("tens", True), ("percent", False)], ["sale_id", "line_no", "quantity", "amount_cents"], places=2)
    return ranked.select("vendor_id", "part", "month", "pos", F.col("pos").alias("place"), "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")


#: crc32 is folded over the digits of the number.
SQL = r"""
WITH steps AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::UBIGINT] || list_transform(range(8), lambda k: 0::UBIGINT),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
sums AS (
  SELECT sale_id, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(length(s)), lambda i: ascii(substr(s, i + 1, 1))::UBIGINT),
      lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT % 5 = 0 AS one
  FROM (SELECT DISTINCT sale_id, sale_id::VARCHAR AS s FROM sale_lines WHERE sale_id IS NOT NULL), steps),
l AS (
  SELECT CASE WHEN one THEN -1 ELSE vendor_id END::BIGINT AS vendor_id, CASE WHEN one THEN -1 ELSE coalesce(item_id % 5, -1) END::BIGINT AS part,
    CASE WHEN one THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END::BIGINT AS month,
    floor(quantity / 10.0)::BIGINT AS tens, floor(100 * discount + 0.5)::BIGINT AS percent, sale_id::BIGINT AS sale_id, line_no::BIGINT AS line_no,
    quantity::BIGINT AS quantity, floor(100 * amount + 0.5)::BIGINT AS amount_cents
  FROM sale_lines LEFT JOIN sums USING (sale_id)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS LAST, percent NULLS LAST, sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST)::BIGINT AS pos,
    count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent)::BIGINT AS tied
  FROM l)
SELECT vendor_id, part, month, pos, pos AS place, sale_id, line_no, quantity, percent, amount_cents, tied FROM r WHERE pos <= 2
"""
