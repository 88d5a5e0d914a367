"""Token counts from distinct pre-tokens: of a pre-token only the number of its tokens is kept, ids of a text are never put together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abridge.llm import textkit
from abridge.llm.common import small_batches
from abridge.llm.pieces import pieces


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; other columns are not read.

    n_tokens is what the tokenizers library gives for the file `tokenizer` (a byte-level BPE .json) on the
    whole text, without added special tokens. A null text counts as empty: 0 and 0. Rows that repeat an id or a text each
    give a row; texts of any length are read whole, in slices of about 6 MB of rows; an empty table gives no rows.

    Every batch is a join of its distinct pre-tokens' counts with the per-document occurrences. That join
    stays in the batch: sent through a shuffle, the (document, pre-token, frequency) rows would be larger
    than the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(tokenizer)
        for batch in batches:
            text = textkit.as_text(batch.column(1))
            size = pc.binary_length(text)
            counts = [np.zeros(0, np.int64)]
            for which, _, _, size_of, first in known.ragged(text):
                counts.append(_sums(size_of[which], first))
            yield pa.RecordBatch.from_arrays([batch.column(0), size.cast(pa.int64()), pa.array(np.concatenate(counts))], [id_col, "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col))
    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
