"""Query of token packing. SQL has no byte-pair encoding; tests check an exact round trip and the fit."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from abridge.llm.common import table
from abridge.llm.packing import pack_token_ids


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_token_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), length=2048)
