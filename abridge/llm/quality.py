"""Quality by learning from positive and unlabelled texts.

Texts that are labelled good are the only labels read. Unlabelled text holds good and bad in a proportion that nobody
has told, so it is estimated: among the texts that a first classifier of good against unlabelled ranks highest nearly all are good,
and the share of unlabelled texts up there, divided by that of good ones, is the class prior. With it the risk of calling a bad text good
is what unlabelled texts cost less what the good among them cost; where that estimate falls below zero, which a true risk cannot,
steps go back instead (the non-negative unbiased risk). Prior and classifier are then fitted once more from the better ranking.

A text is described by the shares of pairs of neighbouring sign classes, by how often words and lines repeat, and by lengths: shape,
not vocabulary, so it holds over languages. All of it is made with numpy for slices of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abridge.llm import textkit
from abridge.llm.common import small_batches

#: About so many texts of each kind are drawn for fitting.
SAMPLE_GOOD, SAMPLE_UNLABELLED = 6000, 12000
#: Bytes of text described at once. What is counted in a text of over eight times that is added up over its windows, so
#: there words and lines count as met before if the same window has them.
WINDOW = 1 << 20

#: Sign classes: small letters, capitals, digits, blanks, ends of lines, full stops, commas, other marks that end sentences,
#: brackets and quotes, signs of tables and code, other signs, first and following bytes of letters beyond ASCII, controls.
KINDS = 14


def _kinds() -> np.ndarray:
    table = np.full(256, 13, np.uint8)
    for k, signs in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!?", b"()'\"-", b"|<>{}[]/\\_=", b"*#$%&@^~+`")):
        table[list(signs)] = k
    table[192:], table[128:192] = 11, 12
    return table


_KIND = _kinds()
_LINE_END = np.zeros(256, dtype=bool)
_LINE_END[[10, 13]] = True
PAIRS = KINDS * KINDS
#: Sums of a text: pairs of classes, bytes, words, words equal to the one before, or the one before that, lines, lines met before, distinct words.
SUMS = PAIRS + 7


def sums_of(text: pa.Array) -> np.ndarray:
    """What is counted in each text, (texts, SUMS). Pairs do not reach over the ends of texts."""
    data, at = textkit.raw(text)
    n = len(text)
    out = np.zeros((n, SUMS))
    size = np.diff(at)
    if not len(data):
        return out
    kind = _KIND.take(data)
    owner = np.repeat(np.arange(n, dtype=np.int64), size)
    pair = owner[:-1] * PAIRS + kind[:-1].astype(np.int64) * KINDS + kind[1:]
    out[:, :PAIRS] = np.bincount(pair[owner[:-1] == owner[1:]], minlength=n * PAIRS).reshape(n, PAIRS)
    out[:, PAIRS] = size
    words, of = textkit.word_hashes(text)
    word_owner = np.repeat(np.arange(n), np.diff(of))
    out[:, PAIRS + 1] = np.diff(of)
    for back in (1, 2):
        if len(words) > back:
            same = (words[back:] == words[:-back]) & (word_owner[back:] == word_owner[:-back])
            out[:, PAIRS + 1 + back] = np.bincount(word_owner[back:][same], minlength=n)
    if len(words):
        spans = textkit.word_spans(data, at)[0]
        line_of = np.concatenate([[0], np.cumsum(_LINE_END[data])])[spans] + word_owner  # a text begins a line
        first = np.flatnonzero(np.concatenate([[True], line_of[1:] != line_of[:-1]]))
        place = np.arange(len(words)) - np.repeat(first, np.diff(np.append(first, len(words))))
        line = textkit.mix(np.add.reduceat(words * ((place.astype(np.uint64) << np.uint64(1)) | np.uint64(1)), first))
        lines = word_owner[first]
        out[:, PAIRS + 4] = np.bincount(lines, minlength=n)
        order = np.lexsort((line, lines))
        again = (line[order][1:] == line[order][:-1]) & (lines[order][1:] == lines[order][:-1])
        out[:, PAIRS + 5] = np.bincount(lines[order][1:][again], minlength=n)
        order = np.lexsort((words, word_owner))
        fresh = np.concatenate([[True], (words[order][1:] != words[order][:-1]) | (word_owner[order][1:] != word_owner[order][:-1])])
        out[:, PAIRS + 6] = np.bincount(word_owner[order][fresh], minlength=n)
    return out


def features_of(sums: np.ndarray) -> np.ndarray:
    """Square roots of shares, so that rare signs tell as well, and logarithms of lengths."""
    pairs, size = sums[:, :PAIRS], np.maximum(sums[:, PAIRS : PAIRS + 1], 1)
    words, lines = np.maximum(sums[:, PAIRS + 1], 1), np.maximum(sums[:, PAIRS + 4], 1)
    rest = [sums[:, PAIRS + 2] / words, sums[:, PAIRS + 3] / words, sums[:, PAIRS + 5] / lines, np.log(sums[:, PAIRS + 6] + 1) / np.log(words + 1.5)]
    lengths = [np.log1p(sums[:, PAIRS]) / 10, np.log1p(sums[:, PAIRS] / words) / 3, np.log1p(words / lines) / 6]
    return np.concatenate([np.sqrt(pairs / size), np.sqrt(np.stack(rest, 1)), np.stack(lengths, 1)], axis=1).astype(np.float32)


def _windows(text: pa.Array) -> Iterator[pa.Array]:
    """One text in windows that end with a blank, or after twice the bytes."""
    data, _ = textkit.raw(text)
    a = 0
    while a < len(data):
        b = min(a + WINDOW, len(data))
        b += int(np.argmax(np.append(textkit.SPACE[data[b : b + WINDOW]], True)))
        yield pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, b - a])), pa.py_buffer(np.ascontiguousarray(data[a:b]))])
        a = b


def described(text: pa.Array) -> np.ndarray:
    """Features of each whole text, in memory for WINDOW bytes."""
    rows = []
    for a, b in textkit.slices(text, WINDOW):
        part = text.slice(a, b - a)
        large = b - a == 1 and len(textkit.raw(part)[0]) > 8 * WINDOW
        rows.append(sum(map(sums_of, _windows(part))) if large else sums_of(part))
    return features_of(np.concatenate(rows)) if rows else np.zeros((0, PAIRS + 7), np.float32)


@dataclass
class QualityNet:
    """One hidden layer; log odds of good."""

    mean: np.ndarray
    scale: np.ndarray
    w: list[np.ndarray]
    prior: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.scale)[1]

    def _forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(z @ self.w[0] + self.w[1])
        return hidden, hidden @ self.w[2] + self.w[3] + z @ self.w[4]

    def slopes(self, z: np.ndarray, hidden: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        """Of the weights, from those of the log odds."""
        d = np.outer(g, self.w[2]) * (1 - hidden * hidden)
        return [z.T @ d, d.sum(0), hidden.T @ g, np.array(g.sum()), z.T @ g]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def class_prior(good: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of good ones among the unlabelled, from scores of both: the least ratio of the shares above a threshold, with the
    uncertainty of both shares allowed for, so that a few texts at the very top do not decide."""
    cuts = np.unique(np.concatenate([good, unlabelled]))
    above = lambda s: 1 - np.searchsorted(np.sort(s), cuts, "left") / len(s)
    p, u = above(good), above(unlabelled)
    slack = (1 + gamma) * (np.sqrt(np.log(4 / delta) / (2 * len(good))) + np.sqrt(np.log(4 / delta) / (2 * len(unlabelled))))
    ok = p > 0
    k = np.argmin((u[ok] + slack) / p[ok])
    return float(np.clip(u[ok][k] / p[ok][k], 0.05, 0.99))


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def fit_risk(good: np.ndarray, unlabelled: np.ndarray, prior: float | None, hidden: int = 16, steps: int = 1000, batch: int = 512, rate: float = 3e-3, decay: float = 1e-3, seed: int = 11) -> QualityNet:
    """Minimise the non-negative unbiased risk under a class prior with logistic loss; without a prior, plain good against unlabelled."""
    rng = np.random.default_rng(seed)
    every = np.concatenate([good, unlabelled])
    mean, scale = every.mean(0), every.std(0) + 0.02
    d = every.shape[1]
    net = QualityNet(mean, scale, [rng.normal(0, 0.3 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.array(0.0), np.zeros(d)], prior or 0.5)
    zg, zu = (good - mean) / scale, (unlabelled - mean) / scale
    m, v, t = [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w], 0
    parts = max(1, len(zu) // batch)
    for epoch in range(epochs := -(-steps // parts)):
        for part in np.array_split(rng.permutation(len(zu)), parts):
            pick = rng.integers(0, len(zg), len(part))
            hg, fg = net._forward(zg[pick])
            hu, fu = net._forward(zu[part])
            to_good, to_bad_g, to_bad_u = _sigmoid(fg) - 1, _sigmoid(fg), _sigmoid(fu)  # slopes of log(1+e^-f), log(1+e^f)
            if prior is None:
                g, u = to_good / len(pick), to_bad_u / len(part)
            else:
                bad = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fg).mean()
                if bad >= 0:
                    g, u = prior * (to_good - to_bad_g) / len(pick), to_bad_u / len(part)
                else:  # a negative risk is overfitting: undo it
                    g, u = prior * to_bad_g / len(pick), -to_bad_u / len(part)
            grads = [a + b for a, b in zip(net.slopes(zg[pick], hg, g), net.slopes(zu[part], hu, u))]
            t += 1
            step = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
            for k, (w, slope) in enumerate(zip(net.w, grads)):
                slope = slope + decay * w * (w.ndim > 0)
                m[k] = 0.9 * m[k] + 0.1 * slope
                v[k] = 0.999 * v[k] + 0.001 * slope * slope
                net.w[k] = w - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


def fit(good: np.ndarray, unlabelled: np.ndarray) -> QualityNet:
    """Prior from one half ranked by what the other half taught, then the risk under it, twice; at last over all rows."""
    a, b = slice(0, None, 2), slice(1, None, 2)
    prior = None
    for _ in range(3):
        ranked = fit_risk(good[a], unlabelled[a], prior, steps=500)
        prior = class_prior(ranked.logits(good[b]), ranked.logits(unlabelled[b]))
    return fit_risk(good, unlabelled, prior)


def _drawn(rows: DataFrame, id_col: str, about: int) -> DataFrame:
    """About so many rows, by a hash of the id: each with the same chance."""
    n = rows.count()
    return rows if n <= about else rows.where(F.pmod(F.xxhash64(F.lit("drawn"), id_col), F.lit(1 << 40)) < int((1 << 40) * about / n))


def learn_quality(docs: DataFrame, labels: DataFrame, good: int = SAMPLE_GOOD, unlabelled: int = SAMPLE_UNLABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityNet | None:
    """Fit on about `good` texts that `labels` calls 1 and about `unlabelled` texts of `docs`, whatever their labels; bounds are for fitting alone.

    Labels of 0 are not read. An id with several labels is good if any is. Null ids and null texts are not learned from; repeated rows
    count as often as they are drawn. With fewer than 10 texts of either kind there is no model.
    """
    small_batches(docs.sparkSession)
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = labels.where(F.col(id_col).isNotNull() & (F.col(label_col) == 1)).select(F.col(id_col).alias("id")).distinct()
    trusted = _drawn(named, "id", good)  # `good` rows

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = described(textkit.as_text(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    def rows(df: DataFrame) -> np.ndarray:
        got = sorted(bytes(r[0]) for r in df.select("text").mapInArrow(describe, "x binary").collect())
        return np.frombuffer(b"".join(got), np.float32).reshape(-1, PAIRS + 7).astype(float)

    p, u = rows(texts.join(F.broadcast(trusted), "id")), rows(_drawn(texts, "id", unlabelled))
    if min(len(p), len(u)) < 10:
        return None
    rng = np.random.default_rng(3)
    return fit(rng.permutation(p), rng.permutation(u))


def score_quality(docs: DataFrame, net: QualityNet | None, text_col: str = "text") -> DataFrame:
    """All columns of `docs` with `score` (0 to 1) and `predicted` (1 from 0.5 on); columns of these names are replaced.

    Texts are scored whole. Null counts as empty, and an empty text has the score of one without signs, words and lines. Rows that repeat are
    scored each; an empty table gives no rows. Without a model every score is 0.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.drop("score", "predicted")
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            score = net.scores(described(textkit.as_text(batch.column(at)))) if net else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, score double, predicted int")
