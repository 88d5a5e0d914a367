"""Sentences, tokens and words as array columns; predicates on words. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE_BORDER = r"(?<=[.!?])\W+"
# The pronouns that resolution knows.
MALE = ("he", "his", "s/he")
FEMALE = ("she", "her", "s/he")
PLURAL = ("they", "their", "we", "our", "we're", "they're")
POSSESSIVE = ("his", "her", "its", "their")
REPLACED = ("he", "his", "she", "her", "s/he", "they", "their", "they're")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sentence_array(text: Column, split: bool = True) -> Column:
    """Sentences of a text in order: split after . ! ? before non-word characters, or one a line; blanks dropped."""
    parts = F.split(F.coalesce(text, F.lit("")), SENTENCE_BORDER if split else "\n")
    return F.filter(F.transform(parts, lambda s: trimmed(F.replace(s, F.lit("\n"), F.lit(" ")))), lambda s: s != "")


def token_array(sentence: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(sentence, r"\s+"), lambda t: t != "")


def alnum(token: Column, ascii: bool = False) -> Column:
    """A token's letters and digits only."""
    return F.regexp_replace(token, "[^A-Za-z0-9]" if ascii else r"[^\p{L}\p{Nd}]", "")


def idf_normal(token: Column) -> Column:
    """A token without _ . , ! ? - in lower case."""
    return F.lower(F.translate(token, "_.,!?-", ""))


def word_split(sentence: Column) -> Column:
    """Lower-cased pieces between runs of other than letters, digits and _; pieces of _ alone dropped."""
    return F.filter(F.transform(F.split(sentence, r"[^\p{L}\p{Nd}_]+"), F.lower), lambda w: F.replace(w, F.lit("_"), F.lit("")) != "")


def word_array(tokens: Column) -> Column:
    """Lower-cased letters and digits of tokens; tokens without any are dropped."""
    return F.filter(F.transform(tokens, lambda t: F.lower(alnum(t))), lambda w: w != "")


def sentences_of(docs: DataFrame, set_col: str = "doc_id", text_col: str = "text", min_tokens: int = 4, split: bool = True) -> DataFrame:
    """(set_id, sents): the sentences of each row as an array of (text, tokens), with at least `min_tokens` tokens."""
    kept = F.filter(F.transform(sentence_array(F.col(text_col), split), lambda s: F.struct(s.alias("text"), token_array(s).alias("tokens"))), lambda s: F.size(s["tokens"]) >= min_tokens)
    return docs.select(F.col(set_col).alias("set_id"), kept.alias("sents"))


def sentences(docs: DataFrame, set_col: str = "doc_id", text_col: str = "text", min_tokens: int = 4, split: bool = True, order_col: str | None = None) -> DataFrame:
    """(set_id, doc_pos, sent_idx, text, tokens, words) with at least `min_tokens` tokens, numbered from 0 in each set.

    With the default each row is a set of its own and numbering needs no window. With `order_col`, rows of a
    set are its documents, in that order.
    """
    kept = F.filter(F.transform(sentence_array(F.col(text_col), split), lambda s: F.struct(s.alias("text"), token_array(s).alias("tokens"))), lambda s: F.size(s["tokens"]) >= min_tokens)
    if order_col is None:
        rows = docs.select(F.col(set_col).alias("set_id"), F.lit(0).alias("doc_pos"), F.posexplode(kept).alias("sent_idx", "s"))
    else:
        rows = docs.select(F.col(set_col).alias("set_id"), F.col(order_col).alias("doc_pos"), F.posexplode(kept).alias("sent_pos", "s"))
        rows = rows.join(
            rows.groupBy("set_id", "doc_pos").agg(F.count("*").alias("n")).selectExpr("set_id", "doc_pos", "coalesce(sum(n) over (partition by set_id order by doc_pos rows between unbounded preceding and 1 preceding), 0) as before"),
            ["set_id", "doc_pos"],
        ).withColumn("sent_idx", (F.col("before") + F.col("sent_pos")).cast("int"))
    return rows.select("set_id", "doc_pos", "sent_idx", "s.text", "s.tokens", word_array(F.col("s.tokens")).alias("words"))


def bare(token: Column) -> Column:
    """Lower case without one trailing . ? , ! or )."""
    return F.regexp_replace(F.lower(token), r"[.?,!)]$", "")


def is_pronoun(token: Column) -> Column:
    return bare(token).isin(*REPLACED)


def is_male(token: Column) -> Column:
    return bare(token).isin(*MALE)


def is_female(token: Column) -> Column:
    return bare(token).isin(*FEMALE)


def is_plural(token: Column) -> Column:
    return bare(token).isin(*PLURAL)


def is_possessive(token: Column) -> Column:
    return bare(token).isin(*POSSESSIVE)


def is_punctuation(token: Column) -> Column:
    return token.isin(".", "?", ",", "!", ")")


def is_title(token: Column) -> Column:
    return token.rlike("^[A-Z][a-z0-9]*$")


def repaired(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again as UTF-8."""
    return F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.parse_url(url, F.lit("HOST")), r"^www\.", "")


def html_lines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\n\n"), F.lit("\n")), F.lit("\n"), F.lit("<br /><br />\n"))
