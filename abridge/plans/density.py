"""A query of clusters by density over `documents`, and its SQL."""

from abridge.config import Config
from abridge.functions.text import sentences
from abridge.operators.density import density_clusters
from abridge.operators.select import cosine_pairs
from abridge.plans import sql as Q
from abridge.plans.catalog import docs_of, query
from abridge.plans.words import STOP


@query(Q.cte(Q.cosine(False), """
sd AS (SELECT set_id, i, j, round(s, 9) AS s FROM cos WHERE s > 0 UNION ALL SELECT set_id, j, i, round(s, 9) FROM cos WHERE s > 0),
core AS (SELECT set_id, i FROM sd WHERE s >= 0.8 GROUP BY ALL HAVING count(*) >= 2),
ed AS (SELECT sd.set_id, sd.i, sd.j FROM sd JOIN core a ON a.set_id = sd.set_id AND a.i = sd.i JOIN core b ON b.set_id = sd.set_id AND b.i = sd.j WHERE s >= 0.8),
reach AS (SELECT set_id, i, i AS r FROM core UNION SELECT e.set_id, e.j, reach.r FROM reach JOIN ed e ON e.set_id = reach.set_id AND e.i = reach.i),
root AS (SELECT set_id, i, min(r) AS root FROM reach GROUP BY ALL),
own AS (SELECT set_id, i, dense_rank() OVER (PARTITION BY set_id ORDER BY root) - 1 AS k FROM root),
edge AS (SELECT sd.set_id, sd.i, o.k FROM sd JOIN own o ON o.set_id = sd.set_id AND o.i = sd.j WHERE s >= 0.8 QUALIFY row_number() OVER (PARTITION BY sd.set_id, sd.i ORDER BY s DESC, sd.j) = 1)""").replace("WITH ", "WITH RECURSIVE ", 1)
+ "SELECT s.set_id, s.sent_idx, coalesce(o.k, e.k, -1)::INT AS k FROM s LEFT JOIN own o ON o.set_id = s.set_id AND o.i = s.sent_idx LEFT JOIN edge e ON e.set_id = s.set_id AND e.i = s.sent_idx")
def cluster_density(spark, d):
    """Sentences of every document by density: three within a distance of 0.2 make a core."""
    docs = docs_of(spark, d)
    return density_clusters(sentences(docs), cosine_pairs(docs, Config(bigrams=False), STOP), 0.2, 3)
