"""Query of token counts. SQL has no byte-pair encoding; tests compare with the library."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from abridge.llm.common import table
from abridge.llm.token_counts import token_counts


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)
