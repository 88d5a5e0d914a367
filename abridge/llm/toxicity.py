"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding maps homoglyphs, accents, full-width and mathematical letters to plain ones, digits to the letters they
stand in for, drops invisible marks, and keeps words apart by two blanks, so that " word " and
" stem" are patterns with word borders. The lexicon is learned from labels: whole words and stems that toxic
documents hold far more often, weighted by log odds. Exception phrases, learned from clean documents, are
longer patterns; a hit inside one does not count. The summed weights, and their density in the
text, are turned into a probability by a logistic regression on the same sample.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abridge.llm import textkit
from abridge.llm.common import small_batches, stored

#: Labelled documents learned from at most, of each label.
SAMPLE = 6000
STEMS = (4, 5, 6, 7)

# Digits and signs as the letters they replace; letters of other scripts as the Latin ones they resemble.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e"}
ALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
}


def _fold_table() -> dict[int, str | None]:
    """By rule: the plain letter below accents and compatibility forms; then the fixed values above."""
    table: dict[int, str | None] = {}
    for low, high in ((0x80, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0x2070, 0x2190), (0x2460, 0x2500), (0xFF00, 0xFF60), (0x1D400, 0x1D800)):
        for code in range(low, high):
            plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)).lower() if not unicodedata.combining(c))
            plain = "".join(ALIKE.get(c, c) for c in plain)
            if plain and plain != chr(code):
                table[code] = plain
    table |= {c: None for c in (*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
    table |= {ord(c): v for c, v in (DIGITS | ALIKE).items()}
    return table


_TABLE: dict[int, str | None] = {}
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Folded words, each between blanks of its own."""
    if not _TABLE:
        _TABLE.update(_fold_table())
    return " " + "  ".join(_WORD.findall(text.lower().translate(_TABLE))) + " "


@dataclass
class Lexicon:
    """Weights of patterns, exception phrases, and the regression on (log weight, log density, any hit)."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    beta: np.ndarray = field(default_factory=lambda: np.array([-30.0, 0, 0, 0]))

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for p, w in self.weights.items():
            machine.add_word(p, (len(p), w, p))
        for p in self.exceptions:
            machine.add_word(p, (len(p), 0.0, p))
        machine.make_automaton()
        return machine

    def hits(self, machine, folded: str) -> list[tuple[int, int, float, str]]:
        """The heaviest hit at each place, without those inside exceptions."""
        best: dict[int, tuple[int, int, float, str]] = {}
        free: list[tuple[int, int]] = []
        for end, (size, weight, pattern) in machine.iter(folded):
            start = end - size + 1
            if weight == 0:
                free.append((start, end))
            elif start not in best or best[start][2] < weight:
                best[start] = (start, end, weight, pattern)
        if free:
            # a hit may reach one blank beyond the phrase that excuses it
            free.sort()
            begins, reach = np.array([f[0] for f in free]), np.maximum.accumulate([f[1] for f in free])
            return [h for h in best.values() if not ((k := np.searchsorted(begins, h[0], "right")) and reach[k - 1] >= h[1])]
        return list(best.values())

    def features(self, texts: Iterator[str], machine=None) -> np.ndarray:
        machine = machine or (self.automaton() if self.weights else None)
        rows = []
        for text in texts:
            folded = fold(text)
            found = self.hits(machine, folded) if machine else []
            total, words = sum(h[2] for h in found), max(1, folded.count("  ") + 1)
            rows.append((1.0, np.log1p(total), np.log1p(1000 * total / words), float(bool(found))))
        return np.array(rows).reshape(-1, 4)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.beta, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 0.05) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - ridge * beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic documents, clean documents) of a batch: whole words and stems."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(textkit.as_text(batch.column(0)), batch.column(1).to_pylist()):
            terms = set()
            for word in set(fold(text.as_py()).split()):
                if len(word) >= 3:
                    terms.add(f" {word} ")
                    terms.update(f" {word[:k]}" for k in STEMS if k <= len(word))
            counts[toxic].update(terms)
        every = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([counts[1][t] for t in every], pa.int64()), pa.array([counts[0][t] for t in every], pa.int64())], ["term", "toxic", "clean"])


def _contexts(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """(phrase, toxic documents, clean documents): the word of each hit, alone and with its neighbours."""
    machine = lexicon.automaton()
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(textkit.as_text(batch.column(0)), batch.column(1).to_pylist()):
            folded, phrases = fold(text.as_py()), set()
            for start, _, _, pattern in lexicon.hits(machine, folded):
                end = folded.find(" ", start + 1)
                left, right = folded.rfind(" ", 0, max(0, start - 1)), folded.find(" ", end + 2)
                word = folded[start : end + 1]
                phrases.add(word) if word.strip() != pattern.strip() else None
                if left >= 0:
                    phrases.add(folded[left : end + 1])
                if right >= 0:
                    phrases.add(folded[start : right + 1])
            counts[toxic].update(phrases)
        every = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([counts[1][t] for t in every], pa.int64()), pa.array([counts[0][t] for t in every], pa.int64())], ["term", "toxic", "clean"])


def learn_lexicon(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """Learn from the `sample` labelled documents of least id hash, of each label; the bound is for fitting alone.

    Patterns must be met in a hundredth of the toxic documents, so there are at most 100 x the mean number of terms of one.
    Of terms met in as many toxic documents the longest stands for all, so a stem is not learned from one word. Rows that repeat an id all count,
    with the id's greatest label; of equal texts one does, toxic if any is. Null texts are not learned from. Without documents of both labels the
    lexicon is empty and scores are nearly 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__y"))
    drawn = [ids.where(F.col("__y") == y).orderBy(F.xxhash64(id_col), id_col).limit(sample) for y in (1, 0)]
    taken = F.broadcast(drawn[0].union(drawn[1]))  # 2 x sample rows
    rows = stored(docs.join(taken, id_col).select(F.col(text_col).alias("text"), "__y").where("text is not null").groupBy("text").agg(F.max("__y").alias("__y")), "labelled")
    n = {r[0]: r[1] for r in rows.groupBy("__y").count().collect()}
    if len(n) < 2:
        return Lexicon()
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    least = max(4, n[1] // 100)
    terms = rows.mapInArrow(_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # Purity before frequency: a stem must be met nearly only in toxic documents.
    strong = terms.where(F.col("toxic") >= least).withColumn("odds", odds).where("odds > 2.5").orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "term").collect()
    weights: dict[str, float] = {}
    longer: dict[str, set[int]] = {}  # toxic documents of the chosen terms that begin with a stem
    for r in sorted(strong, key=lambda r: (-r["odds"] * np.log1p(r["toxic"]), -len(r["term"]), r["term"])):
        term = r["term"]
        shorter = [f" {term.strip()[:k]}" for k in range(1, len(term.strip()) + 1)]
        if r["toxic"] not in longer.get(term, ()) and not any(s in weights for s in shorter if s != term):
            weights[term] = min(float(r["odds"]), 8.0)
            for s in shorter:
                longer.setdefault(s, set()).add(r["toxic"])
    lexicon = Lexicon(weights)
    if not weights:
        return lexicon
    sent = spark.sparkContext.broadcast(lexicon)
    phrases = rows.mapInArrow(lambda b: _contexts(b, sent.value), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    excused = phrases.where(F.col("clean") >= 3).withColumn("odds", odds).where("odds < 0").orderBy(F.desc("clean"), "term").collect()
    lexicon.exceptions = [r["term"] for r in excused if r["term"] not in weights]
    sent = spark.sparkContext.broadcast(lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value.automaton()
        for batch in batches:
            x = sent.value.features((t.as_py() for t in textkit.as_text(batch.column(0))), machine)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(4)), batch.column(1)], ["x0", "x1", "x2", "x3", "y"])

    got = rows.mapInArrow(measure, "x0 double, x1 double, x2 double, x3 double, y int").toPandas().sort_values(["x1", "x2", "y"]).to_numpy(float)
    lexicon.beta = _logistic(got[:, :4], got[:, 4])
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs` with `score` (0 to 1) and `predicted` (1 from 0.5 on); columns of these names are replaced.

    Null and blank texts have no hits and get the score of a text without hits. Texts are scored whole, one after the other, whatever their
    length; rows that repeat are scored each; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = docs.drop("score", "predicted")
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = sent.value
        machine = lexicon.automaton() if lexicon.weights else None
        for batch in batches:
            scores = lexicon.scores(lexicon.features((t.as_py() for t in textkit.as_text(batch.column(at))), machine))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, score double, predicted int")
