"""Query of benchmark decontamination. SQL has no approximate search of this size; tests compare with a full dynamic programme."""

from pyspark.sql import DataFrame, SparkSession

from abridge.llm.common import table
from abridge.llm.decontamination import contaminations


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
