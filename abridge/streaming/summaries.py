"""Summaries of arriving documents: each micro-batch is summarised as a table of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from abridge.api import summarize
from abridge.config import Config


def summarize_stream(docs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, config: Config | None = None, set_col: str = "doc_id"):
    """Start a query that hands (set_id, summary) of each micro-batch to `sink`; a set must arrive whole in one batch."""

    def batch(rows: DataFrame, epoch: int) -> None:
        sink(summarize(rows, config or Config(), set_col), epoch)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
