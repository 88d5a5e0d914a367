"""Summaries of documents, files and user matrices: the functions a caller starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from abridge.config import Config
from abridge.functions.text import sentences, word_array
from abridge.operators import anaphora, cluster, combine, measures, render, select, terms
from abridge.sources import readers
from abridge.sources.lists import Lists

#: A whole summary: tf-idf of stems, sentiment and, where vectors are given, word vectors, multiplied.
SUMMARY = Config(use_sentiment=True, use_embeddings=True, stemmer="porter2")


def pair_measures(sents: DataFrame, config: Config, lists: Lists = Lists(), several: bool = False) -> list[DataFrame]:
    """The measures in use as (set_id, i, j, s), in order. Their size is the square of a set's sentences."""
    found = []
    for name in _measures(config, lists):
        if name == "tfidf":
            w = tfidf_weights(sents, config, several, lists)
            found.append(measures.tfidf_cosine(w, terms.norms(w)))
        elif name == "embed":
            found.append(measures.embedding_pairs(measures.sentence_embeddings(sents, lists.vectors, lists.dim)))
        else:
            found.append(measures.sentiment_pairs(measures.sentiment_fractions(sents, lists.positive, lists.negative), name))
    return found


def _measures(config: Config, lists: Lists) -> tuple[str, ...]:
    """Without vectors or emotion words there is no measure of them; with none left, tf-idf."""
    given = {"embed": lists.vectors is not None, "pos": bool(lists.positive), "neg": bool(lists.negative)}
    return tuple(m for m in config.measures if given.get(m, True)) or ("tfidf",)


def tfidf_weights(sents: DataFrame, config: Config, several: bool = False, lists: Lists = Lists()) -> DataFrame:
    """Weights of each sentence's terms. Documents of the lists' corpus count for df; else, with several documents in a set, those, or sentences (`idf_unit`); else its sentences."""
    bags = terms.bag(sents, lists.stop, config.stemmer, config.bigrams, lists.clusters, config.clusters_in_place)
    if lists.idf_documents is not None:
        corpus = sentences(lists.idf_documents, "doc_id", "text", 1, split=False)
        idfs = terms.corpus_idf(corpus, lists.stop, config.stemmer, config.idf_mode, lists.clusters)
    elif several and config.idf_unit == "documents":
        placed = bags.join(sents.select("set_id", "sent_idx", "doc_pos"), ["set_id", "sent_idx"])
        sizes = sents.groupBy("set_id").agg(F.countDistinct("doc_pos").alias("docs"))
        # A set of one document counts sentences.
        place = F.when(F.col("docs") > 1, F.col("doc_pos").cast("string")).otherwise(F.col("sent_idx").cast("string"))
        idfs = terms.idf(placed.join(sizes, "set_id").withColumn("place", place), ("place",), mode=config.idf_mode, docs=sents.join(sizes, "set_id").withColumn("place", place))
    else:
        idfs = terms.idf(bags, ("sent_idx",), mode=config.idf_mode, docs=sents)
    return terms.weighted(bags, idfs, config.zero_idf_as_one)


def choose(docs: DataFrame, config: Config = Config(), set_col: str = "doc_id", text_col: str = "text", order_col: str | None = None, lists: Lists = Lists(), split: bool = True, steps: list[list[float]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, sentences) of each set.

    Sets of up to `config.kernel_limit` sentences are chosen from in one task each, larger ones by joins; the results are the same. `steps` are weights of
    the measures for each step of the choice (average).
    """
    sents = sentences(docs, set_col, text_col, config.min_tokens, split, order_col)
    if config.resolve_pronouns:
        sents = anaphora.resolve_pronouns(sents, lists.male, lists.female)
        sents = sents.withColumn("tokens", F.split("resolved", " ")).withColumn("text", F.col("resolved")).withColumn("words", word_array(F.col("tokens"))).drop("resolved")
    if config.input_limit:
        sents = select.sampled(sents, config.input_limit, config.seed)
    plain = order_col is None and not (config.input_limit or config.resolve_pronouns or steps) and config.stemmer in ("none", "porter2") and lists.clusters is None and lists.idf_documents is None
    large = _large(docs, sents, config, set_col, text_col)
    some = not large.isEmpty()
    if some:
        large = large.checkpoint() if select.shared_checkpoints(docs.sparkSession) is None else large
        small, big = sents.join(large, "set_id", "left_anti"), sents.join(large, "set_id", "left_semi")
    else:
        small, big = sents, None
    names = _measures(config, lists)
    if plain and "embed" not in names:
        rows = docs if big is None else docs.join(large, docs[set_col] == large["set_id"], "left_anti")
        if names == ("tfidf",) and config.stemmer == "none":
            found = select.select_documents(rows, config, lists.stop, set_col, text_col, split).drop("line")
        else:
            near = not config.cluster_on_aggregate and config.clusterings == "one"
            found = select.select_measures(rows, config, names, near, lists.positive, lists.negative, lists.stop, set_col, text_col, split)
    else:
        found = _by_features(small, config, order_col is not None, lists, steps)
    return (found if big is None else found.union(_by_joins(big, config, order_col is not None, lists, steps))), sents


def _large(docs: DataFrame, sents: DataFrame, config: Config, set_col: str, text_col: str) -> DataFrame:
    """(set_id) of the sets of more than `config.kernel_limit` sentences. A sentence takes two bytes for each of its least tokens, so only sets of as many bytes
    are looked at; of the others nothing but lengths is read."""
    size = docs.groupBy(F.col(set_col).alias("set_id")).agg(F.sum(F.octet_length(text_col)).alias("bytes"))
    maybe = size.where(F.col("bytes") >= 2 * max(1, config.min_tokens) * config.kernel_limit).select("set_id")
    found = sents.select("set_id").join(maybe, "set_id", "left_semi")
    return found.groupBy("set_id").agg(F.count("*").alias("n")).where(F.col("n") > config.kernel_limit).select("set_id")


def observed(sents: DataFrame, selection: DataFrame, name: str = "abridge") -> tuple[DataFrame, DataFrame, Observation, Observation]:
    """The same tables, with what is known of a run once their rows have been made: sentences, their tokens and the longest (of `sents`), and
    chosen sentences, steps and the best and the least score (of `selection`). No job is run for it."""
    of_sents, of_choice = Observation(f"{name}-sentences"), Observation(f"{name}-choice")
    seen = sents.observe(of_sents, F.count(F.lit(1)).alias("sentences"), F.sum(F.size("tokens")).alias("tokens"), F.max(F.size("tokens")).alias("longest"), F.max("sent_idx").alias("last"))
    made = selection.observe(of_choice, F.count(F.lit(1)).alias("chosen"), F.max("step").alias("steps"), F.max("score").alias("best"), F.min("score").alias("least"))
    return seen, made, of_sents, of_choice


def _by_features(sents: DataFrame, config: Config, several: bool, lists: Lists, steps: list[list[float]] | None) -> DataFrame:
    names = _measures(config, lists)
    near = not config.cluster_on_aggregate and config.clusterings == "one"
    weights = tfidf_weights(sents, config, several, lists) if near or "tfidf" in names else None
    features = measures.sentiment_fractions(sents, lists.positive, lists.negative)
    if "embed" in names:
        features = features.join(measures.sentence_embeddings(sents, lists.vectors, lists.dim), ["set_id", "sent_idx"], "left")
    else:
        features = features.withColumn("vec", F.lit(None).cast("array<double>"))
    return select.select_by_features(weights, features, sents, config, names, near, steps)


def _by_joins(sents: DataFrame, config: Config, several: bool, lists: Lists, steps: list[list[float]] | None = None) -> DataFrame:
    found = pair_measures(sents, config, lists, several)
    near = None
    if not config.cluster_on_aggregate and config.clusterings == "one":
        w = tfidf_weights(sents, config, several, lists)
        near = measures.tfidf_cosine(w, terms.norms(w))
    return _chosen_by_joins(sents, found, near, None, config, steps)


def clusters_by_joins(sents: DataFrame, pairs: DataFrame, config: Config) -> DataFrame:
    """(set_id, sent_idx, k) by the way that `config.clustering` names, for sets of any size."""
    select.shared_checkpoints(sents.sparkSession)
    if config.clustering == "medoids":
        return cluster.kmedoids(sents, pairs, config.seed)
    return cluster.pam(sents, pairs, config.seed) if config.clustering == "pam" else cluster.distance_medoids(sents, pairs, config.seed)


def _chosen_by_joins(sents: DataFrame, found: list[DataFrame], near: DataFrame | None, known: DataFrame | None, config: Config, steps: list[list[float]] | None) -> DataFrame:
    """As `select.select_by_matrix`, by joins: clusters are `known`, those of `near`, of each measure, or of the combined one, anew for each step's weights."""
    select.shared_checkpoints(sents.sparkSession)
    stack, n = combine.stacked(found).checkpoint(), len(found)
    if known is not None:
        fixed = [sents.select("set_id", "sent_idx").join(known, ["set_id", "sent_idx"], "left").select("set_id", "sent_idx", F.coalesce("k", F.lit(0)).alias("k"))]
    elif near is not None:
        fixed = [clusters_by_joins(sents, near, config)]
    else:
        fixed = [clusters_by_joins(sents, m.where("s <> 0"), config) for m in found] if config.clusterings == "each" else None

    def at(weights: list[float] | None, whole: float = 1.0) -> tuple[DataFrame, list[DataFrame]]:
        pairs = combine.combined(stack, n, config.aggregate) if weights is None else combine.weighted_average(stack, sents.sparkSession.createDataFrame([(0, m, float(x)) for m, x in enumerate(weights)], "step int, matrix_id int, w double"), n)
        pairs = pairs.where("s <> 0").checkpoint()
        full = select.with_diagonal(pairs, sents)
        if whole != 1.0:
            full = full.withColumn("s", F.when(F.col("i") == F.col("j"), whole).otherwise(F.col("s")))
        return full, fixed or [clusters_by_joins(sents, pairs, config)]

    if not steps:
        return select.greedy(*((x := at(None))[0], sents, x[1]), config=config)
    even = [1 / n] * n
    weights_at = lambda k: steps[k] if k < len(steps) else even
    return select.greedy(stack, sents, [], config=config, at_step=lambda k: at(weights_at(k), sum(weights_at(k))), stages=len(steps))


def get_clustering(docs: DataFrame, config: Config = Config(), set_col: str = "doc_id", text_col: str = "text", order_col: str | None = None, lists: Lists = Lists()) -> DataFrame:
    """(set_id, sent_idx, k): k-medoids of each set's sentences by tf-idf cosine, or by the combined measure with `cluster_on_aggregate`."""
    select.shared_checkpoints(docs.sparkSession)
    sents = sentences(docs, set_col, text_col, config.min_tokens, True, order_col)
    if config.cluster_on_aggregate:
        found = pair_measures(sents, config, lists, order_col is not None)
        return cluster.kmedoids(sents, combine.combined(combine.stacked(found), len(found), config.aggregate), config.seed)
    w = tfidf_weights(sents, config, order_col is not None, lists)
    return cluster.kmedoids(sents, measures.tfidf_cosine(w, terms.norms(w)), config.seed)


def summarize(docs: DataFrame, config: Config = SUMMARY, set_col: str = "doc_id", text_col: str = "text", order_col: str | None = None, lists: Lists = Lists()) -> DataFrame:
    """(set_id, summary) of each set, sentences in document order."""
    return render.summary_text(*choose(docs, config, set_col, text_col, order_col, lists))


def summarize_text(spark: SparkSession, text: str, length: int = 100, unit: str = "WORDS", lists: Lists = Lists()) -> str:
    """The summary of one text."""
    from dataclasses import replace

    rows = summarize(spark.createDataFrame([(0, text)], "doc_id long, text string"), replace(SUMMARY, length=length, unit=unit), lists=lists).collect()
    return rows[0]["summary"] if rows else ""


def summarize_files(spark: SparkSession, paths: str | list[str], config: Config = SUMMARY, split: bool = True, lists: Lists = Lists(), numbers: bool = False) -> DataFrame:
    """One summary for all documents of the files together; or the numbers of its sentences."""
    docs = readers.text_documents(spark, paths)
    chosen, sents = choose(docs, config, "set_id", "text", "doc_id", lists, split)
    return render.summary_numbers(chosen) if numbers else render.summary_text(chosen, sents)


def summarize_matrices(spark: SparkSession, matrices: list[str], sentence_file: str, config: Config = Config(), weights_file: str | None = None, clustering_file: str | None = None, lists: Lists = Lists()) -> DataFrame:
    """(set_id, step, sent_idx, score) from similarity matrices and a file of one sentence a line.

    `weights_file` has weights of the matrices for each step. Clusters are those of `clustering_file` if it is named, else of the sentences' tf-idf
    cosine, or of the matrices (`cluster_on_aggregate`, `clusterings`).
    """
    sents = readers.sentence_lines(spark, sentence_file)
    found = [readers.similarity_matrix(spark, m, "input", k).where("i < j") for k, m in enumerate(matrices)]
    steps, known, near = None, None, None
    if weights_file:
        rows = readers.matrix_weights(spark, weights_file, len(matrices)).orderBy("step", "matrix_id").collect()  # one line of a file
        steps = [[r["w"] for r in rows if r["step"] == k] for k in sorted({r["step"] for r in rows})]
        steps = [s + [1 / len(matrices)] * (len(matrices) - len(s)) for s in steps]
    if clustering_file:
        known = readers.clustering_file(spark, clustering_file)
    elif not config.cluster_on_aggregate and config.clusterings == "one":
        w = tfidf_weights(sents, config, False, lists)
        near = measures.tfidf_cosine(w, terms.norms(w))
    if sents.count() > config.kernel_limit:
        return _chosen_by_joins(sents, found, near, known, config, steps)
    return select.select_by_matrix(combine.stacked(found), len(found), sents, config, near, steps, known)
