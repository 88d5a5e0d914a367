"""The English (Porter2) stemmer from its published definition, for distinct words in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOWELS = set("aeiouy")
# The published algorithm's exceptions and endings.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
BEFORE_LI = set("cdeghkmnrt")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _region(word: str, start: int) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    for k in range(start + 1, len(word)):
        if word[k] not in VOWELS and word[k - 1] in VOWELS:
            return k + 1
    return len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS and word[-1] not in "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def porter2(word: str) -> str:
    """The stem of a lower-cased word."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    word = word.removeprefix("'")
    word = "".join("Y" if c == "y" and (k == 0 or word[k - 1] in VOWELS) else c for k, c in enumerate(word))
    head = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = len(head) if head else _region(word, 0)
    r2 = _region(word, r1)
    if end := _longest(word, ("'s'", "'s", "'")):
        word = word[: -len(end)]

    end = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        word = word[:-2]
    elif end in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif end == "s" and any(c in VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in KEPT:
        return word

    end = _longest(word, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and any(c in VOWELS for c in word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif len(word) <= r1 and _short_end(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    end = _longest(word, STEP2)
    if end and len(word) - len(end) >= r1:
        stem = word[: -len(end)]
        if not (end == "ogi" and not stem.endswith("l") or end == "li" and stem[-1:] not in BEFORE_LI):
            word = stem + STEP2[end]
    end = _longest(word, STEP3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + STEP3[end]
    end = _longest(word, STEP4)
    if end and len(word) - len(end) >= r2 and not (end == "ion" and word[-4:-3] not in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short_end(word[:-1])) or word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def porter2_stems(words: DataFrame) -> DataFrame:
    """(word, stem) of a table of distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if w is None else porter2(w) for w in found], pa.string())], ["word", "stem"])

    return words.select("word").mapInArrow(run, "word string, stem string")
