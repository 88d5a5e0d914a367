"""Summaries as text, numbers and ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary_text(selection: DataFrame, sents: DataFrame, order: str = "sent_idx") -> DataFrame:
    """(set_id, summary): sentences a line, in document order or in order of choice (`step`)."""
    rows = selection.join(sents.select("set_id", "sent_idx", F.array_join("tokens", " ").alias("line")), ["set_id", "sent_idx"])
    lines = F.transform(F.sort_array(F.collect_list(F.struct(order, "line"))), lambda r: r["line"])
    return rows.groupBy("set_id").agg(F.array_join(lines, "\n").alias("summary"))


def chosen_lines(selection: DataFrame, order: str = "sent_idx") -> DataFrame:
    """As `summary_text`, for a selection that has its lines."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(order, "line"))), lambda r: r["line"])
    return selection.groupBy("set_id").agg(F.array_join(lines, "\n").alias("summary"))


def summary_numbers(selection: DataFrame) -> DataFrame:
    """(set_id, numbers): one-based sentence numbers in document order."""
    return selection.groupBy("set_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.col("sent_idx") + 1)), lambda n: n.cast("string")), " ").alias("numbers"))


def running_length(selection: DataFrame, sents: DataFrame | None = None) -> DataFrame:
    """(set_id, step, sent_idx, words_so_far). A selection that has its lines needs no `sents`: tokens are joined by one blank in a line."""
    rows = selection.withColumn("n", F.size(F.split("line", " "))) if sents is None else selection.join(sents.select("set_id", "sent_idx", F.size("tokens").alias("n")), ["set_id", "sent_idx"])
    return rows.selectExpr("set_id", "step", "sent_idx", "sum(n) over (partition by set_id order by step) as words_so_far")
