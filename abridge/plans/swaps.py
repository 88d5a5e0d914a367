"""A query of swaps of medoids over `documents`, and its SQL, which adds each swap's utility up anew."""

from pyspark.sql import functions as F

from abridge.config import Config
from abridge.operators.select import document_swap_gains
from abridge.plans import sql as Q
from abridge.plans.catalog import docs_of, query, rounded
from abridge.plans.words import STOP


@query(Q.cte(Q.cosine(False), """
md AS (SELECT set_id, k, sent_idx AS medoid FROM (SELECT set_id, sent_idx, row_number() OVER (PARTITION BY set_id ORDER BY md5('7:' || sent_idx)) - 1 AS k FROM s) WHERE k < 3),
sy AS (SELECT set_id, i, j, s FROM cos WHERE s > 0 UNION ALL SELECT set_id, j, i, s FROM cos WHERE s > 0),
pl AS (SELECT s.set_id, s.sent_idx AS i FROM s LEFT JOIN md ON md.set_id = s.set_id AND md.medoid = s.sent_idx WHERE md.k IS NULL),
nw AS (SELECT set_id, coalesce(sum(best), 0) AS total FROM (SELECT pl.set_id, pl.i, max(sy.s) AS best FROM pl JOIN sy ON sy.set_id = pl.set_id AND sy.i = pl.i JOIN md ON md.set_id = sy.set_id AND md.medoid = sy.j GROUP BY ALL) GROUP BY 1),
ov AS (SELECT m.set_id, m.k, s.sent_idx AS i, max(coalesce(sy.s, 0)) AS rest FROM md m JOIN s ON s.set_id = m.set_id LEFT JOIN md o ON o.set_id = m.set_id AND o.k <> m.k
  LEFT JOIN sy ON sy.set_id = m.set_id AND sy.i = s.sent_idx AND sy.j = o.medoid
  WHERE NOT EXISTS (SELECT 1 FROM md x WHERE x.set_id = m.set_id AND x.k <> m.k AND x.medoid = s.sent_idx) GROUP BY ALL),
af AS (SELECT ov.set_id, ov.k, pl.i AS item, sum(CASE WHEN ov.i = pl.i THEN 0 ELSE greatest(ov.rest, coalesce(sy.s, 0)) END) AS total
  FROM ov JOIN pl ON pl.set_id = ov.set_id LEFT JOIN sy ON sy.set_id = ov.set_id AND sy.i = ov.i AND sy.j = pl.i GROUP BY ALL)""")
+ "SELECT set_id, k::INT AS k, item AS sent_idx, round(af.total - coalesce(nw.total, 0), 6) + 0.0 AS gain FROM af LEFT JOIN nw USING (set_id)")
def cluster_swap_gains(spark, d):
    """What each swap of one of three seeded medoids of every document would gain."""
    return rounded(document_swap_gains(docs_of(spark, d), Config(bigrams=False), 3, STOP), "gain").withColumn("gain", F.col("gain") + 0.0)
