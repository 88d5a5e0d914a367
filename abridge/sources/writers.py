"""Matrices, idf tables and digests written as text or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_matrix(full: DataFrame, path: str) -> None:
    """Rows `a, b, c` in order of i, for each set a folder. `full` is (set_id, i, j, s) with both directions."""
    rows = full.groupBy("set_id", "i").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("j", "s"))), lambda c: c["s"].cast("string")), ", ").alias("value"))
    rows.repartition("set_id").sortWithinPartitions("set_id", "i").select("set_id", "value").write.partitionBy("set_id").text(path)


def save_idf(idfs: DataFrame, path: str) -> None:
    """Lines `term: idf`, sorted by term over all files."""
    idfs.orderBy("term").select(F.concat(F.col("term"), F.lit(": "), F.col("idf").cast("string")).alias("value")).write.text(path)


def save_pages(pages: DataFrame, path: str) -> None:
    """HTML of each set, a line break between; (set_id, html)."""
    pages.select("html").write.text(path)


def save_dense_graph(full: DataFrame, path: str) -> None:
    """For clustering programs: a header with the number of rows, then the rows of a similarity matrix, for each set a folder. `full` has both directions and the diagonal."""
    rows = full.groupBy("set_id", "i").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("j", "s"))), lambda c: c["s"].cast("string")), " ").alias("value"))
    head = full.groupBy("set_id").agg(F.countDistinct("i").cast("string").alias("value")).select("set_id", F.lit(-1).alias("i"), "value")
    rows.select("set_id", "i", "value").union(head).repartition("set_id").sortWithinPartitions("set_id", "i").select("set_id", "value").write.partitionBy("set_id").text(path)


def save_clustering(clusters: DataFrame, path: str) -> None:
    """The cluster of each sentence, one a line in order, for each set a folder: what `readers.clustering_file` reads."""
    clusters.repartition("set_id").sortWithinPartitions("set_id", "sent_idx").select("set_id", F.col("k").cast("string").alias("value")).write.partitionBy("set_id").text(path)
