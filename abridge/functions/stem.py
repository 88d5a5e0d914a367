"""Porter's stemmer as column expressions, built from rule tables.

The text of each expression uses only CASE, left, right, length and one regular-expression test, so that the same
rules give SQL for Spark and for DuckDB. Stem the distinct vocabulary, not every token.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Suffix rules of M. F. Porter, "An algorithm for suffix stripping" (1980), with the author's later "bli" and "logi".
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
SOME = f"^({_C})?{_V}{_C}"  # measure over 0
ONE = f"^({_C})?{_V}{_C}({_V})?$"  # measure 1
MANY = f"^({_C})?{_V}{_C}{_V}{_C}"  # measure over 1
VOWEL = f"^({_C})?[aeiouy]"
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"  # consonant, vowel, consonant: takes an e
_TESTS = tuple(re.compile(p) for p in (SOME, MANY, ONE, VOWEL, SHORT))


def _rules(test: str):
    """Expressions over w, one after the other."""
    has = lambda s, p: f"{test}({s}, '{p}')"
    ends = lambda s: f"right(w, {len(s)}) = '{s}'"
    stem = lambda s: f"left(w, cast(greatest(length(w) - {len(s)}, 0) as int))" if s else "w"
    swap = lambda s, r, p: f"WHEN {ends(s)} THEN CASE WHEN {has(stem(s), p)} THEN {stem(s) if not r else f'concat({stem(s)}, {chr(39)}{r}{chr(39)})'} ELSE w END"
    by_size = lambda xs: sorted(xs, key=len, reverse=True)
    yield f"CASE WHEN {ends('sses')} OR {ends('ies')} THEN {stem('es')} WHEN {ends('ss')} THEN w WHEN {ends('s')} THEN {stem('s')} ELSE w END"
    # 1b leaves a mark where ed or ing went, for the repairs that follow it
    yield f"CASE WHEN {ends('eed')} THEN CASE WHEN {has(stem('eed'), SOME)} THEN {stem('d')} ELSE w END WHEN {ends('ed')} AND {has(stem('ed'), VOWEL)} THEN concat({stem('ed')}, '+') WHEN {ends('ing')} AND {has(stem('ing'), VOWEL)} THEN concat({stem('ing')}, '+') ELSE w END"
    cut = "left(w, cast(greatest(length(w) - 1, 0) as int))"
    yield f"CASE WHEN right(w, 1) <> '+' THEN w WHEN {has('w', '(at|bl|iz)[+]$')} THEN concat({cut}, 'e') WHEN right({cut}, 1) = left(right({cut}, 2), 1) AND length({cut}) > 1 AND {has('w', '[^aeioulszy][+]$')} THEN left({cut}, cast(length({cut}) - 1 as int)) WHEN {has(cut, ONE)} AND {has(cut, SHORT)} THEN concat({cut}, 'e') ELSE {cut} END"
    yield f"CASE WHEN {ends('y')} AND {has(stem('y'), VOWEL)} THEN concat({stem('y')}, 'i') ELSE w END"
    yield "CASE " + " ".join(swap(s, STEP2[s], SOME) for s in by_size(STEP2)) + " ELSE w END"
    yield "CASE " + " ".join(swap(s, STEP3[s], SOME) for s in by_size(STEP3)) + " ELSE w END"
    four = []
    for s in by_size(STEP4):
        more = f" AND {has(stem(s), '[st]$')}" if s == "ion" else ""
        four.append(f"WHEN {ends(s)} THEN CASE WHEN {has(stem(s), MANY)}{more} THEN {stem(s)} ELSE w END")
    yield "CASE " + " ".join(four) + " ELSE w END"
    yield f"CASE WHEN {ends('e')} AND ({has(stem('e'), MANY)} OR {has(stem('e'), ONE)} AND NOT {has(stem('e'), SHORT)}) THEN {stem('e')} ELSE w END"
    yield f"CASE WHEN {ends('ll')} AND {has('w', MANY)} THEN {cut} ELSE w END"


@lru_cache(1 << 18)
def porter_word(word: str) -> str:
    """The stem of one word, by the same rules as `porter`."""
    if len(word) <= 2:
        return word
    some, many, one, vowel, short = (p.search for p in _TESTS)
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if some(w[:-3]) else w
    elif w.endswith("ed") and vowel(w[:-2]) or w.endswith("ing") and vowel(w[:-3]):
        w = w[: -2 if w.endswith("ed") else -3]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulszy":
            w = w[:-1]
        elif one(w) and short(w):
            w += "e"
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        end = next((w[-k:] for k in range(min(7, len(w)), 2, -1) if w[-k:] in rules), None)
        if end and some(w[: -len(end)]):
            w = w[: -len(end)] + rules[end]
    end = next((w[-k:] for k in range(min(5, len(w)), 1, -1) if w[-k:] in STEP4), None)
    if end and many(w[: -len(end)]) and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (many(w[:-1]) or one(w[:-1]) and not short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and many(w) else w


def porter(words: DataFrame, column: str = "word", to: str = "stem") -> DataFrame:
    """`words` with the stem of each word; words of up to two letters stay. Input is expected in lower case."""
    out = words.withColumn("w", F.col(column))
    for rule in _rules("regexp_like"):
        out = out.withColumn("w", F.expr(f"CASE WHEN length(`{column}`) <= 2 THEN w ELSE {rule} END"))
    return out.withColumnRenamed("w", to)


def porter_sql(source: str, column: str = "word", to: str = "stem", test: str = "regexp_matches") -> str:
    """A subquery with all columns of `source` and the stem."""
    sql = f"SELECT *, {column} AS w FROM {source}"
    for rule in _rules(test):
        sql = f"SELECT * EXCLUDE (w), CASE WHEN length({column}) <= 2 THEN w ELSE {rule} END AS w FROM ({sql})"
    return f"SELECT * EXCLUDE (w), w AS {to} FROM ({sql})"
