"""Query of language identification. A learned label has no SQL; tests measure it on held-out rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abridge.llm.common import table
from abridge.llm.language import identify_language, learn_languages

FOLD = "crc32(cast(doc_id as string)) % 4"


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = learn_languages(docs.select("doc_id", "text", "lang").where(f"{FOLD} <> 2"))
    found = identify_language(docs.select("doc_id", "text"), net)
    return found.select("doc_id", F.expr(f"coalesce({FOLD} = 2, false)").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
