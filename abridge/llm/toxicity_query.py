"""Query of toxicity scores. A learned score has no SQL; tests measure it on held-out labels."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abridge.llm.common import table
from abridge.llm.toxicity import learn_lexicon, score_toxicity

FOLD = "crc32(cast(doc_id as string)) % 5"


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn_lexicon(docs, table(spark, sf_dir, "labels").where(f"{FOLD} <> 0"))
    return score_toxicity(docs, lexicon).select("doc_id", F.expr(f"coalesce({FOLD} = 0, false)").alias("held_out"), "score", "predicted")
