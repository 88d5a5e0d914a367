"""Pronouns resolved with the last name of the same gender in earlier sentences of the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abridge.functions.text import is_female, is_male, is_plural, is_possessive, is_pronoun, is_title


def _last_name(tokens: Column, names: tuple[str, ...]) -> Column:
    """The last name of a sentence (compared without case, written with a capital, without a final sign), with the token after it if that is capitalised too."""
    plain = F.transform(tokens, lambda t: F.regexp_replace(t, r"[.?,!)]$", ""))
    named = lambda t: F.lower(t).isin(*names) & t.rlike("^[A-Z]")
    last = F.array_max(F.filter(F.transform(plain, lambda t, i: F.when(named(t), i)), lambda i: i.isNotNull()))
    name = F.try_element_at(plain, (last + 1).cast("int"))
    after = F.try_element_at(plain, (last + 2).cast("int"))
    # A name that ends with a sign ends there.
    return F.when(~F.try_element_at(tokens, (last + 1).cast("int")).rlike(r"[.?,!)]$") & is_title(after), F.concat(name, F.lit(" "), after)).otherwise(name)


def _marked(token: Column, name: Column) -> Column:
    """A pronoun followed by "(Name)" or "(Name's)", its final sign after that; null without a name."""
    sign = F.regexp_extract(token, r"[.?,!)]$", 0)
    word = F.regexp_replace(token, r"[.?,!)]$", "")
    return F.concat(word, F.lit(" ("), name, F.when(is_possessive(token), F.lit("'s")).otherwise(F.lit("")), F.lit(")"), sign)


def resolve_with_entities(sents: DataFrame, entities: DataFrame) -> DataFrame:
    """`sents` with `resolved` from a recogniser's results (set_id, sent_idx, pos, type, entity).

    The person is that of the last PERSON found up to and in the sentence; a plural pronoun stays as it is once another entity was met.
    """
    last = entities.groupBy("set_id", "sent_idx").agg(F.max_by(F.struct("type", "entity"), "pos").alias("e"))
    rows = sents.join(last, ["set_id", "sent_idx"], "left")
    rows = rows.withColumns({"p": F.when(F.col("e.type") == "PERSON", F.col("e.entity")), "o": F.when(F.col("e.type") != "PERSON", F.col("e.entity"))})
    so_far = "over (partition by set_id, doc_pos order by sent_idx rows between unbounded preceding and current row)"
    rows = rows.withColumns({"p": F.expr(f"last(p, true) {so_far}"), "o": F.expr(f"last(o, true) {so_far}")})
    swap = lambda t: F.when(is_pronoun(t) & ~(is_plural(t) & F.col("o").isNotNull()), F.coalesce(_marked(t, F.col("p")), t)).otherwise(t)
    return rows.withColumn("resolved", F.array_join(F.transform("tokens", swap), " ")).drop("e", "p", "o")


def resolve_with_tags(sents: DataFrame, tags: DataFrame) -> DataFrame:
    """`sents` with `resolved` from a tagger's results (set_id, sent_idx, pos, tag), positions of tokens from 0.

    Antecedents are the last NNP, or NNPS for plural pronouns, before the pronoun in the document; a pronoun without one stays.
    """
    words = sents.select("set_id", "doc_pos", "sent_idx", F.posexplode("tokens").alias("pos", "t")).join(tags, ["set_id", "sent_idx", "pos"], "left")
    bare = F.regexp_replace("t", r"""^[.?!,'"\s]+|[.?!,'"\s]+$""", "")
    words = words.withColumns({"one": F.when((F.col("tag") == "NNP") & ~is_pronoun(F.col("t")), bare), "many": F.when((F.col("tag") == "NNPS") & ~is_pronoun(F.col("t")), bare)})
    before = "over (partition by set_id, doc_pos order by sent_idx, pos rows between unbounded preceding and 1 preceding)"
    words = words.withColumns({"one": F.expr(f"last(one, true) {before}"), "many": F.expr(f"last(many, true) {before}")})
    name = F.when(is_plural(F.col("t")) & F.col("many").isNotNull(), F.col("many")).otherwise(F.col("one"))
    words = words.withColumn("t", F.when(is_pronoun(F.col("t")), F.coalesce(_marked(F.col("t"), name), F.col("t"))).otherwise(F.col("t")))
    lines = words.groupBy("set_id", "sent_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), " ").alias("resolved"))
    return sents.join(lines, ["set_id", "sent_idx"])


def resolve_pronouns(sents: DataFrame, male: tuple[str, ...], female: tuple[str, ...]) -> DataFrame:
    """`sents` with `resolved`: each he/she form followed by "(Name)" or "(Name's)", its final sign after that.

    The name is the last of that gender in an earlier sentence of the same document; a sentence that names one itself keeps its pronouns.
    """
    rows = sents.withColumns({"m": _last_name(F.col("tokens"), male), "f": _last_name(F.col("tokens"), female)})
    earlier = "over (partition by set_id, doc_pos order by sent_idx rows between unbounded preceding and 1 preceding)"
    rows = rows.withColumns({"pm": F.expr(f"last(m, true) {earlier}"), "pf": F.expr(f"last(f, true) {earlier}")})

    def swap(t: Column) -> Column:
        return F.coalesce(_marked(t, F.when(is_male(t) & F.col("m").isNull(), F.col("pm")).when(is_female(t) & F.col("f").isNull(), F.col("pf"))), t)

    return rows.withColumn("resolved", F.array_join(F.transform("tokens", swap), " ")).drop("m", "f", "pm", "pf")
