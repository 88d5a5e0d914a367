"""Query of SentencePiece encoding. SQL has no such search; tests compare with the library and decode again."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abridge.llm.common import table
from abridge.llm.sentencepieces import encode_pieces


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "round_trip")
