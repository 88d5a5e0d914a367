"""Query of repaired conversations and its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abridge.llm.common import table
from abridge.llm.conversation_repair import repair_conversations


def damaged(rows: DataFrame) -> DataFrame:
    """Turns dropped (`alive` is false), emptied, without full stops, repeated or given the role user, by a checksum of their number."""
    hit = F.expr("crc32(concat(coalesce(cast(conv_id AS string), ' '), ':', coalesce(cast(turn AS string), ' '))) % 20")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), hit.alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("hit") != 0).alias("alive"), F.explode(times).alias("copy"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")), alive_col="alive")


#: One step of the recursion reads the next turn of every conversation; s, u and a are the best ways that end so, n the one without output.
SQL = r"""
WITH RECURSIVE steps AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::UBIGINT] || list_transform(range(8), lambda k: 0::UBIGINT),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295::UBIGINT] || list_transform(range(length(k)), lambda i: ascii(substr(k, i + 1, 1))::UBIGINT),
      lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT % 20 AS hit
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations), steps),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN hit = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hit WHERE hit <> 0),
numbered AS (
  SELECT *, row_number() OVER w AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS empty, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
    lag(substr(role, 1, 1)) OVER w || substr(role, 1, 1) AS two
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (empty) AS blank, count(*) FILTER (seen AND NOT empty) AS duplicate,
    count(*) FILTER (cut AND NOT seen AND NOT empty) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows_read
  FROM numbered GROUP BY conv_id),
dp AS (
  SELECT conv_id, 0 AS k, {'c': 0, 'e': '', 'o': ''} AS n, {'c': 1000000000, 'e': '', 'o': ''} AS s, {'c': 1000000000, 'e': '', 'o': ''} AS u, {'c': 1000000000, 'e': '', 'o': ''} AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, k,
    {'c': n.c + 4, 'e': n.e || 'D', 'o': n.o},
    list_sort([{'c': s.c + 4, 'e': s.e || 'D', 'o': s.o}, {'c': n.c + x + CASE WHEN i = 's' AND ok THEN 0 ELSE 1000000000 END, 'e': n.e || 'K', 'o': n.o || chr(10) || own}])[1],
    list_sort([{'c': u.c + 4, 'e': u.e || 'D', 'o': u.o},
      {'c': n.c + x + ku, 'e': n.e || 'K', 'o': n.o || chr(10) || own}, {'c': s.c + x + ku, 'e': s.e || 'K', 'o': s.o || chr(10) || own},
      {'c': a.c + x + ku, 'e': a.e || 'K', 'o': a.o || chr(10) || own}, {'c': u.c + x + ku + 3, 'e': u.e || 'IK', 'o': u.o || chr(10) || 'assistant:' || chr(10) || own},
      {'c': n.c + x + r, 'e': n.e || 'R', 'o': n.o || chr(10) || 'user:' || text}, {'c': s.c + x + r, 'e': s.e || 'R', 'o': s.o || chr(10) || 'user:' || text},
      {'c': a.c + x + r, 'e': a.e || 'R', 'o': a.o || chr(10) || 'user:' || text}, {'c': u.c + x + r + 3, 'e': u.e || 'IR', 'o': u.o || chr(10) || 'assistant:' || chr(10) || 'user:' || text}])[1],
    list_sort([{'c': a.c + 4, 'e': a.e || 'D', 'o': a.o},
      {'c': n.c + x + ka + 3, 'e': n.e || 'IK', 'o': n.o || chr(10) || 'user:' || chr(10) || own}, {'c': s.c + x + ka + 3, 'e': s.e || 'IK', 'o': s.o || chr(10) || 'user:' || chr(10) || own},
      {'c': a.c + x + ka + 3, 'e': a.e || 'IK', 'o': a.o || chr(10) || 'user:' || chr(10) || own}, {'c': u.c + x + ka, 'e': u.e || 'K', 'o': u.o || chr(10) || own},
      {'c': n.c + x + r + 3, 'e': n.e || 'IR', 'o': n.o || chr(10) || 'user:' || chr(10) || 'assistant:' || text}, {'c': s.c + x + r + 3, 'e': s.e || 'IR', 'o': s.o || chr(10) || 'user:' || chr(10) || 'assistant:' || text},
      {'c': a.c + x + r + 3, 'e': a.e || 'IR', 'o': a.o || chr(10) || 'user:' || chr(10) || 'assistant:' || text}, {'c': u.c + x + r, 'e': u.e || 'R', 'o': u.o || chr(10) || 'assistant:' || text}])[1]
  FROM (
    SELECT dp.conv_id, m.k, n, s, u, a, m.text, m.i, m.ok, m.own, CASE WHEN m.cut THEN 3 ELSE 0 END AS x, CASE WHEN m.ok THEN 3 ELSE 1000000000 END AS r,
      CASE WHEN m.ok AND m.i = 'u' THEN 0 ELSE 1000000000 END AS ku, CASE WHEN m.ok AND m.i = 'a' THEN 0 ELSE 1000000000 END AS ka
    FROM dp JOIN (SELECT *, NOT (empty OR seen) AS ok, substr(role, 1, 1) AS i, role || ':' || text AS own FROM numbered) m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id AND m.k = dp.k + 1)),
ended AS (
  SELECT dp.conv_id, list_sort([{'c': n.c, 'e': n.e, 'o': n.o}, {'c': a.c, 'e': a.e, 'o': a.o}, {'c': u.c + 3, 'e': u.e || 'I', 'o': u.o || chr(10) || 'assistant:'},
    {'c': s.c + 6, 'e': s.e || 'II', 'o': s.o || chr(10) || 'user:' || chr(10) || 'assistant:'}])[1] AS z, c.*  EXCLUDE (conv_id)
  FROM dp LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE dp.k = coalesce(c.rows_read, 0))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, z.c::BIGINT AS cost, z.e AS audit, sha256(substr(z.o, 2)) AS repaired_sha256
FROM ended
"""
