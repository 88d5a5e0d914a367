"""Text files and directories, matrices, weights, word lists, word clusters and word vectors."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from abridge.functions.text import trimmed, token_array, word_array


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, block): lines of files, read by as many tasks as the files have splits; `block` is where a line's split begins."""
    return spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def numbered(rows: DataFrame, name: str = "at") -> DataFrame:
    """Rows of `lines_of`, perhaps filtered or exploded, with their number in their file, from 0, for `file` and `block`.

    A split's rows are in order in one task, where a running number comes for nothing. What is added up over splits is one count
    for each; no line is sorted or shuffled, and no file is held by one task.
    """
    marked = rows.withColumn("__m", F.monotonically_increasing_id())
    blocks = marked.groupBy("file", "block").agg(F.min("__m").alias("__base"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return marked.join(blocks.select("file", "block", "__base", before.alias("__before")), ["file", "block"]).withColumn(name, F.col("__before") + F.col("__m") - F.col("__base")).drop("file", "block", "__m", "__base", "__before")


def sentence_lines(spark: SparkSession, path: str, set_id: str = "input") -> DataFrame:
    """(set_id, doc_pos, sent_idx, text, tokens, words) of a file of one sentence a line; blank lines are dropped."""
    rows = numbered(lines_of(spark, path).withColumn("text", trimmed(F.col("value"))).where("text <> ''"))
    rows = rows.select(F.lit(set_id).alias("set_id"), F.lit(0).alias("doc_pos"), F.col("at").cast("int").alias("sent_idx"), "text", token_array(F.col("text")).alias("tokens"))
    return rows.withColumn("words", word_array(F.col("tokens")))


def text_documents(spark: SparkSession, path: str | list[str], set_id: str = "input") -> DataFrame:
    """(set_id, doc_id, text): each file is a document; a directory gives its files, not those below it. Order is by path."""
    rows = spark.read.text(path, wholetext=True).select(F.lit(set_id).alias("set_id"), F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    return rows


def corpus_folders(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): the file `sentences` of each folder below path."""
    return spark.read.text(f"{path}/*/sentences", wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def idf_documents(spark: SparkSession, sentences: DataFrame | None, path: str | None = None) -> DataFrame | None:
    """(doc_id, text): documents of a directory if one is named, else each sentence as a document, else nothing.

    With one document alone every idf would be 0, so its sentences count; they stay apart, nothing is put into one row.
    """
    if path:
        return text_documents(spark, path).select("doc_id", "text")
    return None if sentences is None else sentences.select(F.concat_ws(":", "set_id", "sent_idx").alias("doc_id"), "text")


def clustering_file(spark: SparkSession, path: str, set_id: str = "input") -> DataFrame:
    """(set_id, sent_idx, k) of a file that holds a cluster number for each sentence, in order; -1 becomes cluster 0."""
    lines = lines_of(spark, path).select(F.explode(F.filter(F.split("value", r"\s+"), lambda c: c != "")).alias("k"), "file", "block")
    return numbered(lines).select(F.lit(set_id).alias("set_id"), F.col("at").cast("int").alias("sent_idx"), F.greatest(F.col("k").cast("int"), F.lit(0)).alias("k"))


def records_of(ids: DataFrame, records: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The records of a table of ids, by one join; ids without a record are dropped, a repeated id brings its record once."""
    return records.join(ids.select(id_col).distinct(), id_col, "left_semi")


def similarity_matrix(spark: SparkSession, path: str, set_id: str = "input", matrix_id: int = 0) -> DataFrame:
    """(set_id, matrix_id, i, j, s) of a file of rows `a, b, c;`. Cells may stand between commas or blanks; empty and `_` ones are dropped.

    A matrix that is not square raises an error when it is read.
    """
    filled = lambda parts, sep: F.filter(F.split(parts, sep), lambda r: F.regexp_replace(r, r"[\s,_]+", "") != "")
    rows = numbered(lines_of(spark, path).select(F.explode(filled("value", ";")).alias("row"), "file", "block"), "i")
    rows = rows.select("i", filled("row", r"[\s,]+").alias("cells"))
    size = rows.agg(F.count("*").alias("n"), F.min(F.size("cells")).alias("low"), F.max(F.size("cells")).alias("high"))
    fits = size.select(F.assert_true((F.col("n") == 0) | ((F.col("low") == F.col("n")) & (F.col("high") == F.col("n"))), F.lit("matrix is not square")).alias("ok"))  # one row
    cells = rows.crossJoin(F.broadcast(fits)).where("ok is null").select("i", F.posexplode("cells").alias("j", "cell"))
    return cells.select(F.lit(set_id).alias("set_id"), F.lit(matrix_id).alias("matrix_id"), F.col("i").cast("int").alias("i"), "j", F.col("cell").cast("double").alias("s"))


def matrix_weights(spark: SparkSession, path: str, matrices: int) -> DataFrame:
    """(step, matrix_id, w) of the first line of a file: `matrices` weights for each step."""
    first = numbered(lines_of(spark, path)).where("at = 0").select(F.posexplode(F.filter(F.split("value", r"[\s,;]+"), lambda c: c != "")).alias("p", "w"))
    return first.select((F.col("p") / matrices).cast("int").alias("step"), (F.col("p") % matrices).alias("matrix_id"), F.col("w").cast("double").alias("w"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word): trimmed lines, blank ones dropped."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def word_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(word, cluster_id): line n is cluster-n; a word belongs to its first line."""
    words = numbered(lines_of(spark, path), "n").select("n", F.explode(F.split("value", r"\W+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.concat(F.lit("cluster-"), F.min("n")).alias("cluster_id"))


def word2vec_binary(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) of binary word2vec files: a header `count dim`, then each word, a blank, and dim floats.

    A file is read in one task, record after record, by the executor that has it; Spark reads files of up to 2 GB
    so. Larger ones are to be cut into several files, each with a header of its own, below one folder.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for cell in batch.column(0):
                data = cell.as_buffer()
                view = memoryview(data)
                end = bytes(view[:64]).index(b"\n")
                count, dim = map(int, bytes(view[:end]).split())
                at, words, vectors = end + 1, [], []
                for _ in range(count):
                    stop = at
                    while view[stop] != 32:
                        stop += 1
                    words.append(bytes(view[at:stop]).decode("utf-8", "replace").lstrip("\n"))
                    vectors.append(list(struct.unpack(f"<{dim}f", view[stop + 1 : stop + 1 + 4 * dim])))
                    at = stop + 1 + 4 * dim
                    if len(words) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(vectors, pa.list_(pa.float32()))], ["word", "vec"])
                        words, vectors = [], []
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(vectors, pa.list_(pa.float32()))], ["word", "vec"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "word string, vec array<float>")


def word2vec_dim(vectors: DataFrame) -> int:
    """The length of the vectors of a table (word, vec), 0 for an empty one."""
    first = vectors.select(F.size("vec").alias("d")).first()
    return first["d"] if first else 0
