"""A query over `conversations` as they arrive: turns in four micro-batches, sets put together in keyed state."""

from pyspark.sql import functions as F

from abridge.operators.select import scratch_path
from abridge.plans.catalog import docs_of, query
from abridge.streaming.sets import summarize_sets


@query("SELECT conv_id AS set_id, count(*) AS documents, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS digest FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1")
def arriving_sets(spark, d):
    """Conversations begin a minute apart and take turns every 97 seconds, so those on the border of two thirds of the time come in parts. All
    are closed by the end, for time goes on after the last turn."""
    rows = docs_of(spark, d, "conversations").where("conv_id IS NOT NULL").selectExpr("conv_id AS set_id", "timestamp_seconds(1704067200 + 60 * conv_id + 97 * coalesce(turn, 0)) AS at", "turn AS pos", "text")
    path, end = scratch_path(spark, "arriving"), rows.agg(F.max(F.unix_seconds("at"))).first()[0] or 1704067200
    part = F.least(F.floor(3 * (F.unix_seconds("at") - 1704067200) / (end - 1704067199)), F.lit(2))
    for k in range(3):
        rows.where(part == k).coalesce(1 if k else 2).write.parquet(f"{path}/in/{k}")
    key = dict(rows.dtypes)["set_id"]
    for k in (3, 4):  # nothing more than the time
        spark.range(1).selectExpr(f"cast(-1 AS {key}) AS set_id", f"timestamp_seconds({end} + {k} * 1000000) AS at", "0L AS pos", "'' AS text").write.parquet(f"{path}/in/{k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in/*")
    summarize_sets(stream, lambda summaries, late, epoch: None, f"{path}/state", trigger={"availableNow": True}).awaitTermination()
    closed = spark.read.parquet(f"{path}/state-batches/*").where("status = 'closed' AND set_id >= 0")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return closed.groupBy("set_id").agg(F.count("*").alias("documents"), F.md5(F.array_join(texts, "\n")).alias("digest"))
