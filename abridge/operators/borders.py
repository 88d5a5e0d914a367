"""Sentence borders learned from a corpus, for each language, without labels.

After the published method of Kiss and Strunk (2006): an abbreviation is a word that keeps close company with its full
stop, is short, and holds full stops inside; a collocation is a pair over a full stop that belongs together; a sentence starter
follows full stops of other words more often than chance has it. All are log-likelihood ratios over counts, so learning is
two group-bys over the words of a corpus and joins of counted tables, which grow with the vocabulary and not with the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the published method.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
OPENING, CLOSING = "[\"'(\\[{«„“‘]", "[\"')\\]}»”’]"


def core(token: Column) -> Column:
    """A token without brackets and quotes around it."""
    return F.regexp_replace(token, f"^{OPENING}+|{CLOSING}+$", "")


def type_of(token: Column) -> Column:
    """What is counted of a bare token: lower case, one full stop at its end off, numbers as #."""
    word = F.lower(F.regexp_replace(token, r"\.$", ""))
    return F.when(word.rlike(r"^[0-9][0-9.,]*$"), "#").otherwise(word)


def has_stop(token: Column) -> Column:
    """A full stop ends a bare token, and only one."""
    return token.rlike(r"[^.]\.$")


def tokens_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def pair_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, word, stop, following, upper, n): words with and without a full stop; of those with one, the word that follows in the
    text and whether it begins with a capital. A null language is the language ''. Words hold a letter or digit."""
    words = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), tokens_of(F.col(text_col)).alias("t")).where(F.size("t") > 0)
    nexts = F.concat(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(1))), F.array(F.lit(None).cast("string")))
    rows = words.select("lang", F.explode(F.zip_with("t", nexts, lambda a, b: F.struct(a.alias("a"), F.when(a.contains("."), b).alias("b")))).alias("p"))
    # tokens are counted as they are, so that patterns are matched once for each distinct one; what follows is asked only where a full stop may be
    rows = rows.groupBy("lang", "p.a", "p.b").agg(F.count("*").alias("m")).select("lang", core(F.col("a")).alias("a"), core(F.col("b")).alias("b"), "m")
    stop, after = has_stop(F.col("a")), F.when(F.col("b").rlike(r"[\p{L}\p{Nd}]"), F.col("b"))
    rows = rows.select("lang", type_of(F.col("a")).alias("word"), stop.alias("stop"), F.when(stop, type_of(after)).alias("following"), F.coalesce(F.when(stop, after.rlike(r"^\p{Lu}")), F.lit(False)).alias("upper"), "m")
    return rows.where(F.col("word").rlike(r"[\p{L}\p{Nd}#]")).groupBy("lang", "word", "stop", "following", "upper").agg(F.sum("m").alias("n"))


def _log(p: Column) -> Column:
    return F.log(F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12)))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """(lang, word, n_stop, n_bare, score) of all words met with a full stop; `counts` as `pair_counts` gives."""
    per = counts.groupBy("lang", "word").agg(F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).alias("n_stop"), F.sum(F.when(F.col("stop"), F.lit(0)).otherwise(F.col("n"))).alias("n_bare"))
    whole = per.groupBy("lang").agg(F.sum("n_stop").alias("stops"), (F.sum("n_stop") + F.sum("n_bare")).alias("words"))
    rows = per.where("n_stop > 0 AND word <> '#'").join(whole, "lang")
    p = F.col("stops") / F.col("words")
    by_chance = F.col("n_stop") * _log(p) + F.col("n_bare") * _log(1 - p)
    as_one = F.col("n_stop") * F.log(F.lit(0.99)) + F.col("n_bare") * F.log(F.lit(0.01))
    length = F.length(F.replace("word", F.lit("."), F.lit("")))
    inner = F.length("word") - length + 1
    score = -2 * (by_chance - as_one) * F.exp(-length) * inner * F.exp(-F.col("n_bare") * F.log(length))
    return rows.where(length > 0).select("lang", "word", "n_stop", "n_bare", score.alias("score"))


def _ratio(a: str, b: str, both: str, n: str) -> Column:
    """Dunning's ratio of two events counted a and b times, together `both` times, among n."""
    a, b, k, n = (F.col(c).cast("double") for c in (a, b, both, n))
    p, p1, p2 = b / n, k / a, (b - k) / F.greatest(n - a, F.lit(1.0))
    apart = k * _log(p) + (a - k) * _log(1 - p) + (b - k) * _log(p) + (n - a - b + k) * _log(1 - p)
    one = k * _log(p1) + (a - k) * _log(1 - p1) + (b - k) * _log(p2) + (n - a - b + k) * _log(1 - p2)
    return -2 * (apart - one)


@dataclass(frozen=True)
class Borders:
    """What was learned, as tables: abbreviations (lang, word, ...), starters (lang, word, ratio), collocations (lang, word, following, ratio)."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame


def learn_borders(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", counts: DataFrame | None = None) -> Borders:
    """Learn from all texts, each language from its own. `counts` are those of `pair_counts`, if they are at hand (written, say)."""
    counts = pair_counts(docs, lang_col, text_col) if counts is None else counts
    short = abbreviation_scores(counts).where(F.col("score") >= ABBREVIATION)
    known = short.select("lang", "word", F.lit(True).alias("known"))
    single = F.col("word").rlike(r"^\p{L}$") | (F.col("word") == "#")
    of_word = counts.groupBy("lang", F.col("word").alias("following")).agg(F.sum("n").alias("b"))
    all_words = counts.groupBy("lang").agg(F.sum("n").alias("words"))
    after = counts.where(F.col("stop") & F.col("following").isNotNull()).join(known, ["lang", "word"], "left")
    plain = after.where(F.col("known").isNull() & ~single)
    breaks = plain.groupBy("lang").agg(F.sum("n").alias("a"))
    begun = plain.groupBy("lang", "following").agg(F.sum(F.when(F.col("upper"), F.col("n")).otherwise(0)).alias("k"))
    starters = begun.where("k > 0").join(of_word, ["lang", "following"]).join(breaks, "lang").join(all_words, "lang").withColumn("ratio", _ratio("a", "b", "k", "words"))
    starters = starters.where((F.col("ratio") > STARTER) & (F.col("k") * F.col("words") > F.col("a") * F.col("b"))).select("lang", F.col("following").alias("word"), "ratio")
    tied = after.where(F.col("known") | single).groupBy("lang", "word", "following").agg(F.sum("n").alias("k")).where("k > 1")
    own = counts.where("stop").groupBy("lang", "word").agg(F.sum("n").alias("a"))
    pairs = tied.join(own, ["lang", "word"]).join(of_word, ["lang", "following"]).join(all_words, "lang").withColumn("ratio", _ratio("a", "b", "k", "words"))
    pairs = pairs.where((F.col("ratio") > COLLOCATION) & (F.col("k") * F.col("words") > F.col("a") * F.col("b"))).join(starters.select("lang", F.col("word").alias("following")), ["lang", "following"], "left_anti")
    return Borders(short, starters, pairs.select("lang", "word", "following", "ratio"))


def bordered(docs: DataFrame, learned: Borders, set_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(set_id, sent_idx, text): sentences of each row, tokens joined by one blank.

    A sentence ends after ! and ?; after ... if a capital follows; after a full stop unless its word is an abbreviation, an initial or a
    number, in which case only before a capitalised sentence starter, and not inside a collocation. Quotes and brackets stay with their
    sentence. Texts are cut where they are: only a row's distinct words before and after full stops travel, to be looked up.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(set_col).alias("set_id"), lang.alias("lang"), F.col(text_col).alias("text"))
    # only a token that holds one of . ! ? may end a sentence, so only those and what follows them are looked at
    holds = lambda x: x.contains(".") | x.contains("!") | x.contains("?")
    told_of = lambda a, b, at: F.struct(type_of(a).alias("w"), has_stop(a).alias("stop"), a.rlike(r"[!?]$").alias("mark"), a.rlike(r"\.\.$").alias("dots"), type_of(b).alias("f"), b.rlike(r"^\p{Lu}").alias("up"), at.alias("at"))

    def looked_at(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("t", tokens_of(F.col("text"))).drop("text")
        rows = rows.withColumn("m", F.filter(F.transform("t", lambda x, i: F.when(holds(x), F.struct(core(x).alias("a"), core(F.coalesce(F.get("t", i + 1), F.lit(""))).alias("b"), i.alias("i")))), lambda x: x.isNotNull()))
        return rows.withColumn("p", F.transform("m", lambda x: told_of(x["a"], x["b"], x["i"]))).drop("m")

    rows = looked_at(texts)
    asked = F.array_distinct(F.transform(F.filter("p", lambda x: x["stop"]), lambda x: F.struct(x["w"].alias("w"), x["f"].alias("f"))))
    pairs = rows.select("set_id", "lang", F.explode(asked).alias("q")).select("set_id", "lang", "q.w", "q.f").distinct()
    found = (
        pairs.join(learned.abbreviations.select("lang", F.col("word").alias("w"), F.lit(True).alias("short")), ["lang", "w"], "left")
        .join(learned.starters.select("lang", F.col("word").alias("f"), F.lit(True).alias("starts")), ["lang", "f"], "left")
        .join(learned.collocations.select("lang", F.col("word").alias("w"), F.col("following").alias("f"), F.lit(True).alias("tied")), ["lang", "w", "f"], "left")
        .where("short OR starts OR tied")
    )
    told = found.groupBy("set_id", "lang").agg(F.collect_set(F.when(F.col("short"), F.col("w"))).alias("short"), F.collect_set(F.when(F.col("starts"), F.col("f"))).alias("starts"), F.collect_set(F.when(F.col("tied"), F.struct("w", "f"))).alias("tied"))
    rows = looked_at(texts.withColumn("key", F.struct("set_id")).join(told.withColumn("key", F.struct("set_id")).drop("set_id"), ["key", "lang"], "left")).where(F.size("t") > 0)  # texts travel, not what is made of them
    held = lambda name, value: F.coalesce(F.array_contains(name, value), F.lit(False))
    careful = lambda x: held("short", x["w"]) | x["w"].rlike(r"^\p{L}$") | (x["w"] == "#")
    ends = lambda x: x["mark"] | (x["dots"] & x["up"]) | (x["stop"] & ~(careful(x) & ~(x["up"] & held("starts", x["f"]))) & ~held("tied", F.struct(x["w"], x["f"])))
    last = F.size("t") - 1
    cuts = F.filter(F.transform("p", lambda x: F.when(ends(x) & (x["at"] < last), x["at"])), lambda i: i.isNotNull())
    rows = rows.withColumn("e", F.concat(cuts, F.array(last)))
    begin = lambda k: F.when(k == 0, 0).otherwise(F.get("e", k - 1) + 1)
    texts = F.transform("e", lambda e, k: F.array_join(F.slice("t", begin(k) + 1, e - begin(k) + 1), " "))
    return rows.select("set_id", F.posexplode(texts).alias("sent_idx", "text"))
