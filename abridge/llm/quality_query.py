"""Query of quality scores. A learned score has no SQL; tests measure it on held-out labels."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abridge.llm.common import table
from abridge.llm.quality import learn_quality, score_quality

FOLD = "crc32(cast(doc_id as string)) % 3"


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = f"{FOLD} <> 1"
    net = learn_quality(docs.where(seen), table(spark, sf_dir, "labels").where(seen))
    return score_quality(docs, net).select("doc_id", F.expr(f"coalesce({FOLD} = 1, false)").alias("held_out"), "score", "predicted")
