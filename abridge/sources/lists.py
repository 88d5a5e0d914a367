"""Word lists and other side inputs of a summary, from tuples, tables or files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from abridge.sources import readers

#: Words of a list at most: lists become literals of a plan.
MOST_WORDS = 100_000


def literal_words(words: DataFrame) -> tuple[str, ...]:
    """The distinct words of a table (word); a table beyond MOST_WORDS raises an error."""
    found = [r["word"] for r in words.select("word").distinct().limit(MOST_WORDS + 1).collect()]
    if len(found) > MOST_WORDS:
        raise ValueError(f"a word list may hold {MOST_WORDS} words")
    return tuple(sorted(w for w in found if w))


@dataclass(frozen=True)
class Lists:
    """Stop words, emotion words and names; word clusters (word, cluster_id), documents that idfs are counted on
    (doc_id, text), word vectors (word, vec) and their length. Tables may be of any size. Nothing is given by default: without emotion
    words sentiment is no measure, without names no pronoun is resolved; `of_language` has stop words."""

    stop: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    male: tuple[str, ...] = ()
    female: tuple[str, ...] = ()
    clusters: DataFrame | None = field(default=None, compare=False)
    idf_documents: DataFrame | None = field(default=None, compare=False)
    vectors: DataFrame | None = field(default=None, compare=False)
    dim: int = 64


def of_language(spark: SparkSession, language: str = "english", **more) -> Lists:
    """Lists with the stop words that Spark's own StopWordsRemover has for a language (english, swedish, german, ...); `more` are other lists."""
    from pyspark.ml.feature import StopWordsRemover

    return Lists(stop=tuple(sorted({w.lower() for w in StopWordsRemover.loadDefaultStopWords(language)})), **more)


def from_files(
    spark: SparkSession, stop: str | None = None, positive: str | None = None, negative: str | None = None, male: str | None = None, female: str | None = None,
    clusters: str | None = None, idf_directory: str | None = None, idf_folders: str | None = None, vectors: str | None = None, language: str | None = None,
) -> Lists:
    """Lists of one word a line, a clusters file, a directory of idf documents or of folders with a file `sentences`, a word2vec file. What is not named is empty; `language` names stop words of Spark's."""
    given = {"stop": stop, "positive": positive, "negative": negative, "male": male, "female": female}
    found = {name: literal_words(readers.word_list(spark, path)) for name, path in given.items() if path}
    if language and not stop:
        found["stop"] = of_language(spark, language).stop
    if clusters:
        found["clusters"] = readers.word_clusters(spark, clusters)
    if idf_directory:
        found["idf_documents"] = readers.text_documents(spark, idf_directory).select("doc_id", "text")
    elif idf_folders:
        found["idf_documents"] = readers.corpus_folders(spark, idf_folders)
    if vectors:
        found["vectors"] = readers.word2vec_binary(spark, vectors)
        found["dim"] = readers.word2vec_dim(found["vectors"])
    return Lists(**found)
