"""Bags of terms, document frequencies, idf, weights and norms as long tables."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from abridge.functions.stem import porter, porter_word
from abridge.functions.stem2 import porter2, porter2_stems
from abridge.functions.text import sentences_of, word_array


def occurrences(sents: DataFrame) -> DataFrame:
    """(set_id, sent_idx, pos, word), a row for each word."""
    return sents.select("set_id", "sent_idx", F.posexplode("words").alias("pos", "word"))


def with_terms(words: DataFrame, stop: tuple[str, ...] = (), stemmer: str = "none") -> DataFrame:
    """Words with `is_stop` and `term`: the stem of a word, or a stop word as it is."""
    out = words.withColumn("is_stop", F.col("word").isin(*stop) if stop else F.lit(False))
    if stemmer == "none":
        return out.withColumn("term", F.col("word"))
    if stemmer not in ("porter", "porter2"):
        raise ValueError(f"unknown stemmer {stemmer}")
    stems = (porter if stemmer == "porter" else porter2_stems)(words.select("word").distinct())  # one row for each distinct word
    return out.join(stems, "word").withColumn("term", F.when(F.col("is_stop"), F.col("word")).otherwise(F.col("stem"))).drop("stem")


def counted(rows: DataFrame) -> DataFrame:
    """Rows with an array `counted` of (term, tf) for their array `terms`. Sorted, equal terms are runs, and a run is as long as the next
    one begins after it: one pass over each row, no shuffle. Filters on these columns would be made anew before them, so put none right behind."""
    rows = rows.withColumn("up", F.sort_array("terms"))
    rows = rows.withColumn("at", F.array_compact(F.transform("up", lambda t, i: F.when((i == 0) | (t != F.get("up", i - 1)), i))))
    ends = F.when(F.size("up") > 0, F.concat(F.slice("at", 2, F.size("at")), F.array(F.size("up")))).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("counted", F.zip_with("at", ends, lambda a, b: F.struct(F.get("up", a).alias("term"), (b - a).alias("tf")))).drop("terms", "up", "at")


def terms_of(words: Column, stop: tuple[str, ...] = (), bigrams: bool = False) -> Column:
    """An array of a sentence's terms, with repeats: its words but stop words, and bigrams of all of them."""
    singles = F.filter(words, lambda w: ~w.isin(*stop)) if stop else words
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(singles, pairs) if bigrams else singles


def document_frequencies(docs: DataFrame, stop: tuple[str, ...] = (), bigrams: bool = False, set_col: str = "doc_id", text_col: str = "text", min_tokens: int = 4) -> DataFrame:
    """(set_id, term, df, idf) where each row is a set of its own: `idf` of its sentences, in one pass over the rows and without a shuffle."""
    seen = F.flatten(F.transform("sents", lambda s: F.array_distinct(terms_of(word_array(s["tokens"]), stop, bigrams))))
    rows = counted(sentences_of(docs, set_col, text_col, min_tokens).select("set_id", F.size("sents").alias("n"), seen.alias("terms")))
    rows = rows.select("set_id", "n", F.explode_outer("counted").alias("c")).select("set_id", "n", "c.term", F.col("c.tf").cast("long").alias("df")).where("term IS NOT NULL")
    return rows.select("set_id", "term", "df", F.log10(F.col("n") / F.col("df")).alias("idf"))


def document_weights(docs: DataFrame, stop: tuple[str, ...] = (), bigrams: bool = False, set_col: str = "doc_id", text_col: str = "text", min_tokens: int = 4) -> DataFrame:
    """(set_id, term, idf, places) where each row is a set of its own: a term's idf and an array of the (sent_idx, tf) that it is in, ascending; an inverted
    index of each row, in one pass and without a shuffle. Sorted by term and sentence, equal cells are runs, and so are equal terms of the cells."""
    cells = F.flatten(F.transform("sents", lambda s, i: F.transform(terms_of(word_array(s["tokens"]), stop, bigrams), lambda t: F.struct(t.alias("t"), i.alias("i")))))
    rows = counted(sentences_of(docs, set_col, text_col, min_tokens).select("set_id", F.size("sents").alias("n"), cells.alias("terms")))
    rows = rows.withColumn("at", F.array_compact(F.transform("counted", lambda c, k: F.when((k == 0) | (c["term"]["t"] != F.get("counted", k - 1)["term"]["t"]), k))))
    ends = F.when(F.size("at") > 0, F.concat(F.slice("at", 2, F.size("at")), F.array(F.size("counted")))).otherwise(F.array().cast("array<int>"))
    runs = F.zip_with("at", ends, lambda a, b: F.struct(F.get("counted", a)["term"]["t"].alias("term"), F.transform(F.slice("counted", a + 1, b - a), lambda c: F.struct(c["term"]["i"].alias("sent_idx"), c["tf"].alias("tf"))).alias("places")))
    rows = rows.select("set_id", "n", F.explode_outer(runs).alias("r")).where("r IS NOT NULL")
    return rows.select("set_id", "r.term", F.log10(F.col("n") / F.size("r.places")).alias("idf"), "r.places")


def placed_weights(index: DataFrame) -> DataFrame:
    """`weighted` from `document_weights`: (set_id, sent_idx, term, tf, idf, tfidf)."""
    return index.select("set_id", "term", "idf", F.explode("places").alias("p")).select("set_id", "p.sent_idx", "term", "p.tf", "idf", (F.col("p.tf") * F.col("idf")).alias("tfidf"))


def top_words(docs: DataFrame, top: int, stop: tuple[str, ...] = (), set_col: str = "doc_id", text_col: str = "text", min_tokens: int = 4) -> DataFrame:
    """(set_id, sent_idx, words) where each row is a set of its own: the `top` words of greatest tf-idf of each sentence, the first of equals; one pass, no shuffle."""
    rows = sentences_of(docs, set_col, text_col, min_tokens)
    rows = rows.select("set_id", F.transform("sents", lambda s: terms_of(word_array(s["tokens"]), stop)).alias("sents")).where(F.size("sents") > 0)

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part, owner, numbers, chosen = batch.slice(low, 512), [], [], []
                for r, sents in enumerate(part.column(1).to_pylist()):
                    counts = [Counter(s) for s in sents]
                    df = Counter(t for c in counts for t in c)
                    chosen += [sorted(c, key=lambda t: (-round(c[t] * math.log10(len(sents) / df[t]), 9), t))[:top] for c in counts]  # noqa: B023
                    owner += [r] * len(sents)
                    numbers += range(len(sents))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), pa.array(numbers, pa.int32()), pa.array(chosen, pa.list_(pa.string()))], ["set_id", "sent_idx", "words"])

    return rows.mapInArrow(run, f"set_id {dict(rows.dtypes)['set_id']}, sent_idx int, words array<string>")


def bag(sents: DataFrame, stop: tuple[str, ...] = (), stemmer: str = "none", bigrams: bool = False, clusters: DataFrame | None = None, in_place: bool = False) -> DataFrame:
    """(set_id, sent_idx, term, tf): unigrams but stop words, and bigrams of a word with the one before it.

    Stop words take part in bigrams. `clusters` (word, cluster_id) adds the cluster of each unigram, and
    bigrams with clusters for words, beside the originals; or, `in_place`, puts clusters for the terms of words. Without stems or clusters bigrams come from arrays; no
    window is needed.
    """
    if stemmer == "none" and clusters is None:
        return counted(sents.select("set_id", "sent_idx", terms_of(F.col("words"), stop, bigrams).alias("terms"))).select("set_id", "sent_idx", F.explode_outer("counted").alias("c")).select("set_id", "sent_idx", "c.term", "c.tf").where("term IS NOT NULL")
    if clusters is None:
        return _stemmed_bag(sents, stop, stemmer, bigrams)
    rows = with_terms(occurrences(sents), stop, stemmer).join(clusters, "word", "left")
    order = W.partitionBy("set_id", "sent_idx").orderBy("pos")
    if in_place:
        rows = rows.withColumns({"term": F.when(F.col("is_stop"), F.col("term")).otherwise(F.coalesce("cluster_id", "term")), "cluster_id": F.lit(None).cast("string")})
    rows = rows.withColumn("swapped", F.coalesce("cluster_id", "term")).withColumns({"prev": F.lag("term").over(order), "prev_swapped": F.lag("swapped").over(order)})
    single = [F.when(~F.col("is_stop"), F.col("term")), F.when(~F.col("is_stop"), F.col("cluster_id"))]
    double = []
    if bigrams:
        plain, other = F.concat(F.col("prev"), F.lit(" "), F.col("term")), F.concat(F.col("prev_swapped"), F.lit(" "), F.col("swapped"))
        double = [plain, F.when(other != plain, other)]
    return rows.select("set_id", "sent_idx", F.explode(F.array_compact(F.array(*single, *double))).alias("term")).groupBy("set_id", "sent_idx", "term").agg(F.count("*").cast("int").alias("tf"))


#: Words of sentences that are counted at once.
COUNTED = 1 << 19


def _stemmed_bag(sents: DataFrame, stop: tuple[str, ...], stemmer: str, bigrams: bool) -> DataFrame:
    """`bag` of stems, some thousand sentences at a time: a word is stemmed once for these, and terms are counted as numbers; nothing is shuffled."""
    if stemmer not in ("porter", "porter2"):
        raise ValueError(f"unknown stemmer {stemmer}")
    listed = frozenset(stop)
    rows = sents.select("set_id", "sent_idx", "words")

    def counts(part: pa.RecordBatch, stem: Callable[[str], str]) -> pa.RecordBatch:
        lists = part.column(2)
        length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        words = lists.flatten().dictionary_encode()
        known = words.dictionary.to_pylist()
        plain = np.array([w in listed for w in known], bool)
        own = pa.array([w if w in listed else stem(w) for w in known], pa.string()).dictionary_encode()
        names, code = own.dictionary, own.indices.to_numpy()[words.indices.to_numpy()]
        owner = np.repeat(np.arange(len(length)), length)
        single = ~plain[words.indices.to_numpy()]
        sent, term = owner[single], code[single].astype(np.int64)
        if bigrams:
            pair = np.flatnonzero(owner[1:] == owner[:-1])
            both, at = np.unique(code[pair].astype(np.int64) * len(names) + code[pair + 1], return_inverse=True)
            first, second = (names.take(pa.array(x)) for x in np.divmod(both, max(1, len(names))))
            sent, term = np.concatenate([sent, owner[pair]]), np.concatenate([term, at + len(names)])
            names = pa.concat_arrays([names, pc.binary_join_element_wise(first, second, " ")])
        cells, tf = np.unique(sent * max(1, len(names)) + term, return_counts=True)
        sent, term = (pa.array(x) for x in np.divmod(cells, max(1, len(names))))
        return pa.RecordBatch.from_arrays([part.column(0).take(sent), part.column(1).take(sent), names.take(term), pa.array(tf, pa.int32())], ["set_id", "sent_idx", "term", "tf"])

    def run(batches):
        stem = porter_word if stemmer == "porter" else lru_cache(1 << 18)(porter2)
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
            low = 0
            while low < batch.num_rows:
                before = ends[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(ends, before + COUNTED, "right")))
                yield counts(batch.slice(low, high - low), stem)
                low = high

    return rows.mapInArrow(run, f"set_id {dict(rows.dtypes)['set_id']}, sent_idx {dict(rows.dtypes)['sent_idx']}, term string, tf int")


def idf(terms: DataFrame, doc_cols: tuple[str, ...], set_cols: tuple[str, ...] = ("set_id",), mode: str = "real", docs: DataFrame | None = None) -> DataFrame:
    """(*set, term, df, idf) with idf = log10(N / df), N the documents of the set; `floor` divides as integers.

    `docs` holds (*set, *doc) of all documents, for those without a term; else they are those with a term.
    """
    seen = terms.select(*set_cols, *doc_cols, "term").distinct()
    df = seen.groupBy(*set_cols, "term").agg(F.count("*").alias("df"))
    n = (docs if docs is not None else seen).select(*set_cols, *doc_cols).distinct().groupBy(*set_cols).agg(F.count("*").alias("n"))
    joined = df.join(n, list(set_cols)) if set_cols else df.crossJoin(F.broadcast(n))  # one row
    ratio = F.floor(F.col("n") / F.col("df")) if mode == "floor" else F.col("n") / F.col("df")
    return joined.select(*set_cols, "term", "df", F.log10(ratio).alias("idf"))


def idf_of_rows(docs: DataFrame, terms: Column, set_cols: tuple[str, ...] = ("set_id",), mode: str = "real") -> DataFrame:
    """`idf` where each row is a document with an array of terms: (*set, term, df, idf). Documents without terms do not count; nothing is shuffled but counts."""
    rows = docs.select(*set_cols, F.array_distinct(terms).alias("terms")).where(F.size("terms") > 0)
    df = rows.select(*set_cols, F.explode("terms").alias("term")).groupBy(*set_cols, "term").agg(F.count("*").alias("df"))
    n = rows.groupBy(*set_cols).agg(F.count("*").alias("n"))
    ratio = F.floor(F.col("n") / F.col("df")) if mode == "floor" else F.col("n") / F.col("df")
    joined = df.join(n, list(set_cols)) if set_cols else df.crossJoin(F.broadcast(n))  # one row
    return joined.select(*set_cols, "term", "df", F.log10(ratio).alias("idf"))


def corpus_idf(sents: DataFrame, stop: tuple[str, ...] = (), stemmer: str = "none", mode: str = "real", clusters: DataFrame | None = None) -> DataFrame:
    """(term, df, idf) over the documents of a corpus, given as sentences with the document as set_id; bigrams always count."""
    seen = bag(sents, stop, stemmer, True, clusters).select(F.col("set_id").alias("doc_id"), "term")
    return idf(seen, ("doc_id",), (), mode, sents.select(F.col("set_id").alias("doc_id")))


def filled(value: Column, zero_as_one: bool = False) -> Column:
    """A missing idf counts as 1; a zero one too, if asked for."""
    return F.coalesce(F.nullif(value, F.lit(0.0)) if zero_as_one else value, F.lit(1.0))


def weighted(bags: DataFrame, idfs: DataFrame, zero_as_one: bool = False) -> DataFrame:
    """(set_id, sent_idx, term, tf, idf, tfidf). Idfs are those of a set, or, without a set_id, of a corpus of its own."""
    keys = ["set_id", "term"] if "set_id" in idfs.columns else ["term"]
    return bags.join(idfs.select(*keys, "idf"), keys, "left").withColumn("idf", filled(F.col("idf"), zero_as_one)).withColumn("tfidf", F.col("tf") * F.col("idf")).select("set_id", "sent_idx", "term", "tf", "idf", "tfidf")


def norms(weights: DataFrame) -> DataFrame:
    """(set_id, sent_idx, tfidf_norm, idf_norm)."""
    return weights.groupBy("set_id", "sent_idx").agg(F.sqrt(F.sum(F.col("tfidf") ** 2)).alias("tfidf_norm"), F.sqrt(F.sum(F.col("idf") ** 2)).alias("idf_norm"))


def vocabulary(bags: DataFrame) -> DataFrame:
    """(term, term_idx): distinct terms numbered in order.

    Terms are counted by their first two characters, and each such group is numbered on its own, so no task sorts all.
    """
    terms = bags.select("term").distinct().withColumn("head", F.substring("term", 1, 2))
    heads = terms.groupBy("head").agg(F.count("*").alias("n"))
    heads = heads.select("head", (F.coalesce(F.sum("n").over(W.orderBy("head").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    return terms.join(heads, "head").select("term", (F.col("before") + F.row_number().over(W.partitionBy("head").orderBy("term")) - 1).alias("term_idx"))
