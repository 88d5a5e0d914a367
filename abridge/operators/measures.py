"""Sentence-pair measures: (set_id, i, j, s) with i < j, pairs of value 0 left out where the measure is sparse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abridge.operators import terms


def _shared_terms(weights: DataFrame, value: str) -> DataFrame:
    """(set_id, i, j, dot): an inverted index joined with itself; terms of weight 0 add nothing and are left out."""
    a = weights.where(F.col(value) != 0).select("set_id", "term", F.col("sent_idx").alias("i"), F.col(value).alias("x"))
    b = a.select("set_id", "term", F.col("i").alias("j"), F.col("x").alias("y"))
    return a.join(b, ["set_id", "term"]).where("i < j").groupBy("set_id", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))


def _with_norms(pairs: DataFrame, norms: DataFrame, norm: str, kind: str = "inner") -> DataFrame:
    n = norms.select("set_id", "sent_idx", F.col(norm).alias("n"))
    return pairs.join(n.select("set_id", F.col("sent_idx").alias("i"), F.col("n").alias("ni")), ["set_id", "i"]).join(n.select("set_id", F.col("sent_idx").alias("j"), F.col("n").alias("nj")), ["set_id", "j"])


def ratio(x: Column, y: Column) -> Column:
    """x / y, 0 where y is 0."""
    return F.when(y == 0, F.lit(0.0)).otherwise(F.try_divide(x, y))


def tfidf_cosine(weights: DataFrame, norms: DataFrame) -> DataFrame:
    pairs = _with_norms(_shared_terms(weights, "tfidf"), norms, "tfidf_norm")
    return pairs.select("set_id", "i", "j", ratio(F.col("dot"), F.col("ni") * F.col("nj")).alias("s"))


def indexed_cosine(index: DataFrame) -> DataFrame:
    """`tfidf_cosine` from the index of `terms.document_weights`: a term's places are paired where they lie, and sums are begun there; only pairs and norms are shuffled."""
    rows = index.where("idf <> 0").select("set_id", (F.col("idf") * F.col("idf")).alias("q"), "places")
    pairs = rows.where(F.size("places") > 1).select("set_id", "q", "places", F.explode("places").alias("a"))
    pairs = pairs.select("set_id", "q", "a", F.explode(F.filter("places", lambda p: p["sent_idx"] > F.col("a.sent_idx"))).alias("b"))
    dots = pairs.groupBy("set_id", F.col("a.sent_idx").alias("i"), F.col("b.sent_idx").alias("j")).agg(F.sum(F.col("q") * F.col("a.tf") * F.col("b.tf")).alias("dot"))
    sized = _with_norms(dots, terms.norms(terms.placed_weights(index)), "tfidf_norm")
    return sized.select("set_id", "i", "j", ratio(F.col("dot"), F.col("ni") * F.col("nj")).alias("s"))


def all_pairs(rows: DataFrame, *columns: str) -> DataFrame:
    """Pairs i < j of a set's sentences with columns of both (suffixes _i, _j). Its size is the square of a set's: for small sets."""
    a = rows.select("set_id", F.col("sent_idx").alias("i"), *[F.col(c).alias(f"{c}_i") for c in columns])
    b = rows.select("set_id", F.col("sent_idx").alias("j"), *[F.col(c).alias(f"{c}_j") for c in columns])
    return a.join(b, "set_id").where("i < j")


def idf_distance(weights: DataFrame, norms: DataFrame) -> DataFrame:
    """1 - sum of idf^2 over shared terms / norms, for every pair."""
    shared = _shared_terms(weights, "idf")
    pairs = all_pairs(norms, "idf_norm").join(shared, ["set_id", "i", "j"], "left")
    return pairs.select("set_id", "i", "j", F.greatest(1 - ratio(F.coalesce("dot", F.lit(0.0)), F.col("idf_norm_i") * F.col("idf_norm_j")), F.lit(0.0)).alias("d"))


def tfidf_euclidean(weights: DataFrame, norms: DataFrame) -> DataFrame:
    shared = _shared_terms(weights, "tfidf")
    pairs = all_pairs(norms, "tfidf_norm").join(shared, ["set_id", "i", "j"], "left")
    square = F.col("tfidf_norm_i") ** 2 + F.col("tfidf_norm_j") ** 2 - 2 * F.coalesce("dot", F.lit(0.0))
    return pairs.select("set_id", "i", "j", F.sqrt(F.greatest(square, F.lit(0.0))).alias("d"))


def sentiment_fractions(sents: DataFrame, positive: tuple[str, ...], negative: tuple[str, ...]) -> DataFrame:
    """(set_id, sent_idx, n_tokens, pos, neg): shares of tokens on either list; a word on both counts as positive."""
    has = lambda words: (lambda w: w.isin(*words))
    only = tuple(w for w in negative if w not in positive)
    n = F.size("tokens")
    return sents.select("set_id", "sent_idx", n.alias("n_tokens"), ratio(F.size(F.filter("words", has(positive))).cast("double"), n).alias("pos"), ratio(F.size(F.filter("words", has(only))).cast("double"), n).alias("neg"))


def rescaled(pairs: DataFrame, value: str = "s", diagonal: float | None = None) -> DataFrame:
    """Min-max of `value` in each set (counting a diagonal of this value, if given); a constant measure becomes 1, so that it changes no product."""
    low, high = F.min(value), F.max(value)
    if diagonal is not None:
        low, high = F.least(low, F.lit(diagonal)), F.greatest(high, F.lit(diagonal))
    ends = pairs.groupBy("set_id").agg(low.alias("low"), high.alias("high"))
    scaled = F.when(F.col("high") > F.col("low"), F.try_divide(F.col(value) - F.col("low"), F.col("high") - F.col("low"))).otherwise(1.0)
    return pairs.join(ends, "set_id").withColumn(value, scaled).drop("low", "high")


def sentiment_pairs(fractions: DataFrame, side: str) -> DataFrame:
    """1 - the difference of fractions, min-max scaled with the diagonal (1) counted."""
    pairs = all_pairs(fractions, side).select("set_id", "i", "j", (1 - F.abs(F.col(f"{side}_i") - F.col(f"{side}_j"))).alias("s"))
    return rescaled(pairs, diagonal=1.0)


def sentence_embeddings(sents: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(set_id, sent_idx, vec): mean of the vectors of a sentence's words; sentences without any are left out.

    `vectors` is (word, vec). Means are `dim` partial averages, so no list of vectors is gathered.
    """
    words = sents.select("set_id", "sent_idx", F.explode("words").alias("word")).groupBy("set_id", "sent_idx", "word").agg(F.count("*").alias("k"))
    joined = words.join(vectors, "word")
    sums = joined.groupBy("set_id", "sent_idx").agg(F.sum("k").alias("n"), *[F.sum(F.col("vec")[d].cast("double") * F.col("k")).alias(f"v{d}") for d in range(dim)])
    return sums.select("set_id", "sent_idx", F.array(*[F.col(f"v{d}") / F.col("n") for d in range(dim)]).alias("vec"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def embedding_pairs(embedded: DataFrame) -> DataFrame:
    """(cosine + 1) / 2, then min-max scaled over pairs; the diagonal takes no part."""
    normed = embedded.withColumn("size", F.sqrt(dot(F.col("vec"), F.col("vec"))))
    unit = normed.where("size > 0").select("set_id", "sent_idx", F.transform("vec", lambda x: x / F.col("size")).alias("u"))
    pairs = all_pairs(unit, "u").select("set_id", "i", "j", (0.5 * (dot(F.col("u_i"), F.col("u_j")) + 1)).alias("s"))
    return rescaled(pairs)


def dissimilarity(pairs: DataFrame) -> DataFrame:
    """(set_id, i, j, d) with d = 1 - s."""
    return pairs.select("set_id", "i", "j", (1 - F.col("s")).alias("d"))


def extreme_pairs(pairs: DataFrame) -> DataFrame:
    """(set_id, low, low_i, low_j, high, high_i, high_j): the least and the greatest value of each set with its pair, the first pair of equals."""
    first = F.struct((-F.col("i")).alias("i"), (-F.col("j")).alias("j"))
    ends = pairs.groupBy("set_id").agg(F.min(F.struct(F.round("s", 9).alias("s"), "i", "j")).alias("a"), F.max(F.struct(F.round("s", 9).alias("s"), first.alias("at"))).alias("b"))
    return ends.select("set_id", F.col("a.s").alias("low"), F.col("a.i").alias("low_i"), F.col("a.j").alias("low_j"), F.col("b.s").alias("high"), (-F.col("b.at.i")).alias("high_i"), (-F.col("b.at.j")).alias("high_j"))


def vectors_of_words(words: DataFrame, vectors: DataFrame, stems: DataFrame) -> DataFrame:
    """(word, vec) of distinct `words`: a word's own vector, else that of its stem (word, stem); words without either are dropped."""
    own = words.select("word").join(vectors, "word", "left")
    other = vectors.select(F.col("word").alias("stem"), F.col("vec").alias("other"))
    return own.join(stems.select("word", "stem"), "word", "left").join(other, "stem", "left").select("word", F.coalesce("vec", "other").alias("vec")).where("vec is not null")


def tagged_word_pairs(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """(set_id, i, j, a, b, s) of word pairs with the same tag. `words` is (set_id, sent_idx, word, tag), tags from any tagger."""
    unit = _unit_vectors(vectors)
    placed = words.select("set_id", "sent_idx", "word", "tag").distinct().join(unit, "word")
    one = placed.select("set_id", "tag", F.col("sent_idx").alias("i"), F.col("word").alias("a"), F.col("u").alias("u_i"))
    two = placed.select("set_id", "tag", F.col("sent_idx").alias("j"), F.col("word").alias("b"), F.col("u").alias("u_j"))
    return one.join(two, ["set_id", "tag"]).where("i < j").select("set_id", "i", "j", "a", "b", (0.5 * (dot(F.col("u_i"), F.col("u_j")) + 1)).alias("s"))


def nouns(words: DataFrame, tag: str = "NN") -> DataFrame:
    """Words (.., tag) with one tag."""
    return words.where(F.col("tag") == tag)


def _unit_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("size", F.sqrt(dot(F.col("vec"), F.col("vec")))).where("size > 0").select("word", F.transform("vec", lambda x: x / F.col("size")).alias("u"))


def word_pair_scores(sents: DataFrame, vectors: DataFrame, weights: DataFrame | None = None, top_words: int | None = None, weigh: bool = False) -> DataFrame:
    """(set_id, i, j, a, b, s): (cosine + 1) / 2 of each word of one sentence with each of another, of the `top_words` by weight or all.

    Distinct words stand once for a sentence. With `weigh` words of weight 0 take no part: a positive weight of a vector changes its length, not its cosine. `weights` is (set_id, sent_idx, term, tfidf).
    """
    words = sents.select("set_id", "sent_idx", F.explode(F.array_distinct("words")).alias("word"))
    if weigh:
        words = words.join(weights.where("tfidf > 0").select("set_id", "sent_idx", F.col("term").alias("word")), ["set_id", "sent_idx", "word"], "left_semi")
    if top_words is not None:
        scored = words.join(weights.withColumnRenamed("term", "word").select("set_id", "sent_idx", "word", "tfidf"), ["set_id", "sent_idx", "word"])
        words = scored.selectExpr("*", "row_number() over (partition by set_id, sent_idx order by round(tfidf, 9) desc, word) as r").where(F.col("r") <= top_words).select("set_id", "sent_idx", "word")
    placed = words.join(_unit_vectors(vectors), "word")
    return all_pairs(placed, "word", "u").select("set_id", "i", "j", F.col("word_i").alias("a"), F.col("word_j").alias("b"), (0.5 * (dot(F.col("u_i"), F.col("u_j")) + 1)).alias("s"))


def mean_word_pairs(scores: DataFrame, best: int | None = None) -> DataFrame:
    """Mean over all word pairs, or over the `best` highest."""
    if best is not None:
        scores = scores.selectExpr("*", "row_number() over (partition by set_id, i, j order by round(s, 9) desc, a, b) as r").where(F.col("r") <= best)
    return scores.groupBy("set_id", "i", "j").agg(F.avg("s").alias("s"))


def title_overlap(rows: DataFrame, stemmer: str = "none") -> DataFrame:
    """(set_id, i, j, s): equal distinct words, or their stems, / the smaller number of them, of pairs that share one."""
    if stemmer != "none":
        stems = terms.with_terms(terms.occurrences(rows), (), stemmer)
        rows = stems.groupBy("set_id", "sent_idx").agg(F.collect_set("term").alias("words"))  # of one sentence
    words = rows.select("set_id", "sent_idx", F.array_distinct("words").alias("w")).withColumn("n", F.size("w"))
    one = words.select("set_id", "sent_idx", "n", F.explode("w").alias("word"))
    pairs = one.alias("a").join(one.alias("b"), ["set_id", "word"]).where("a.sent_idx < b.sent_idx")
    return pairs.groupBy("set_id", F.col("a.sent_idx").alias("i"), F.col("b.sent_idx").alias("j")).agg((F.count("*") / F.least(F.min("a.n"), F.min("b.n"))).alias("s"))
