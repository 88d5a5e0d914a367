"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read word by word: the bytes of a lower-cased word, a blank before and after, are one
sequence for the network, which gives every position a distribution over the languages. A document's distribution is the mean
over all positions of its words that have a letter; words without one tell no language. The state begins anew with each word, which
is this network's model of a text: since a word's positions then depend on the word alone,
each distinct word of a batch is run once, and workers remember words they have met. Words longer than LONGEST bytes are read in pieces.

Training is backpropagation through time in numpy, with Adam, on a bounded sample of labelled texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abridge.llm import textkit
from abridge.llm.common import small_batches, worker_cache

#: Training documents of each language, pieces of words drawn from each, hidden units a direction.
SAMPLE, WORDS, HIDDEN = 300, 60, 16
#: Longer words are read in pieces of so many bytes.
LONGEST = 32
REMEMBERED = 200_000
#: With many languages fewer words are remembered and run at once, so that no more numbers than these are held.
SUMS, LABELS = 5 * REMEMBERED, 1 << 25


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Direction:
    """Gated recurrent units over byte columns; gates are update z, reset r and candidate c, in this order."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.p = {
            "wx": rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32),
            "wh": (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32),
            "b": np.zeros(3 * hidden, np.float32),
        }

    def forward(self, x: np.ndarray, keep: bool = False):
        """States of shape (time, rows, hidden) for bytes (rows, time)."""
        h, wh = self.h, self.p["wh"]
        state, out, saved = np.zeros((len(x), h), np.float32), np.empty((x.shape[1], len(x), h), np.float32), []
        fed = self.p["wx"] + self.p["b"]
        for t in range(x.shape[1]):
            inp = fed[x[:, t]]
            gates = _sigmoid(inp[:, : 2 * h] + state @ wh[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            held = r * state
            c = np.tanh(inp[:, 2 * h :] + held @ wh[:, 2 * h :])
            if keep:
                saved.append((state, z, r, c, held))
            state = state + z * (c - state)
            out[t] = state
        return out, saved

    def backward(self, x: np.ndarray, saved: list, grad: np.ndarray) -> dict[str, np.ndarray]:
        h, wh = self.h, self.p["wh"]
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        back = np.zeros((len(x), h), np.float32)
        for t in reversed(range(x.shape[1])):
            state, z, r, c, held = saved[t]
            d = grad[t] + back
            dc = d * z * (1 - c * c)
            dz = d * (c - state) * z * (1 - z)
            dheld = dc @ wh[:, 2 * h :].T
            dr = dheld * state * r * (1 - r)
            gates = np.concatenate([dz, dr], axis=1)
            back = d * (1 - z) + dheld * r + gates @ wh[:, : 2 * h].T
            g["wh"][:, : 2 * h] += state.T @ gates
            g["wh"][:, 2 * h :] += held.T @ dc
            every = np.concatenate([gates, dc], axis=1)
            np.add.at(g["wx"], x[:, t], every)
            g["b"] += every.sum(axis=0)
        return g


class LanguageNet:
    """labels(x): the distribution at each position of equally long byte sequences."""

    def __init__(self, names: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.names = names
        self.right, self.left = Direction(hidden, rng), Direction(hidden, rng)
        self.out = {"w": rng.normal(0, 0.2, (2 * hidden, len(names))).astype(np.float32), "b": np.zeros(len(names), np.float32)}

    def _states(self, x: np.ndarray, keep: bool = False):
        a, sa = self.right.forward(x, keep)
        b, sb = self.left.forward(x[:, ::-1], keep)
        return np.concatenate([a, b[::-1]], axis=2), sa, sb

    def labels(self, x: np.ndarray) -> np.ndarray:
        states, _, _ = self._states(x)
        logits = states @ self.out["w"] + self.out["b"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True)

    def loss_and_gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions, and its gradient for each parameter."""
        states, sa, sb = self._states(x, keep=True)
        logits = states @ self.out["w"] + self.out["b"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        many = p.shape[0] * p.shape[1]
        rows = np.arange(len(y))
        loss = -float(np.log(np.maximum(p[:, rows, y], 1e-12)).mean())
        d = p
        d[:, rows, y] -= 1
        d = d / np.float32(many)
        flat, dflat = states.reshape(many, -1), d.reshape(many, -1)
        g = {"out.w": flat.T @ dflat, "out.b": dflat.sum(axis=0)}
        ds = d @ self.out["w"].T
        h = self.right.h
        g |= {f"right.{k}": v for k, v in self.right.backward(x, sa, ds[:, :, :h]).items()}
        g |= {f"left.{k}": v for k, v in self.left.backward(x[:, ::-1], sb, ds[::-1, :, h:]).items()}
        return loss, g

    def parameters(self) -> dict[str, np.ndarray]:
        return {f"{n}.{k}": v for n, part in (("right", self.right.p), ("left", self.left.p), ("out", self.out)) for k, v in part.items()}

    def fit(self, words: list[bytes], y: np.ndarray, epochs: int = 4, batch: int = 256, rate: float = 0.01, seed: int = 4) -> None:
        """Adam over batches of equally long words; the rate falls linearly."""
        rng = np.random.default_rng(seed)
        size = np.array([len(w) for w in words])
        params = self.parameters()
        m, v = ({k: np.zeros_like(p) for k, p in params.items()} for _ in range(2))
        groups = []
        for n in np.unique(size):
            rows = rng.permutation(np.flatnonzero(size == n))
            groups += [rows[k : k + batch] for k in range(0, len(rows), batch)]
        steps, total = 0, epochs * len(groups)
        for _ in range(epochs):
            for k in rng.permutation(len(groups)):
                rows = groups[k]
                x = np.frombuffer(b"".join(words[i] for i in rows), np.uint8).reshape(len(rows), -1)
                _, g = self.loss_and_gradients(x, y[rows])
                steps += 1
                now = rate * (1 - steps / (total + 1))
                for name, p in params.items():
                    m[name] += 0.1 * (g[name] - m[name])
                    v[name] += 0.01 * (g[name] ** 2 - v[name])
                    p -= now * (m[name] / (1 - 0.9**steps)) / (np.sqrt(v[name] / (1 - 0.99**steps)) + 1e-8)


def sequences(word: str) -> list[bytes]:
    """A word's bytes between blanks, in pieces of up to LONGEST bytes that end where a character does."""
    data = b" " + word.encode() + b" "
    if len(data) <= LONGEST:
        return [data]
    out, at = [], 0
    while at < len(data):
        end = min(at + LONGEST, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return out


class Reader:
    """Sums of position labels for words, remembered by the worker."""

    def __init__(self, net: LanguageNet):
        self.net, self.known = net, {}
        self.sums = np.zeros((1024, len(net.names) + 1))

    def of(self, words: list[str]) -> np.ndarray:
        """For each word the summed labels of its positions, and their number; zeros without a letter."""
        if len(self.known) + len(words) > max(min(REMEMBERED, SUMS // self.sums.shape[1]), len(words)):
            self.known.clear()
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        at = len(self.known)
        if at + len(fresh) > len(self.sums):
            self.sums = np.concatenate([self.sums[:at], np.zeros((len(fresh) + at, self.sums.shape[1]))])
        self.sums[at : at + len(fresh)] = 0
        self.known.update(zip(fresh, range(at, at + len(fresh))))
        owners: dict[int, list[int]] = {}
        data: dict[int, list[bytes]] = {}
        for k, word in enumerate(fresh, at):
            if any(map(str.isalpha, word)):
                for piece in sequences(word):
                    owners.setdefault(len(piece), []).append(k)
                    data.setdefault(len(piece), []).append(piece)
        most = max(1, min(2048, LABELS // (LONGEST * self.sums.shape[1])))
        for n, own in owners.items():
            for a in range(0, len(own), most):
                x = np.frombuffer(b"".join(data[n][a : a + most]), np.uint8).reshape(-1, n)
                np.add.at(self.sums, own[a : a + most], np.concatenate([self.net.labels(x).sum(axis=0), np.full((len(x), 1), n)], axis=1))
        return self.sums[[self.known[w] for w in words]] if words else np.zeros((0, self.sums.shape[1]))


def learn_languages(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, words: int = WORDS) -> LanguageNet:
    """Fit on the `sample` rows of least id hash of each language, `words` pieces from all over each text; the bounds are for fitting alone.

    All languages of the rows are learned. Pieces are those that `identify_language` reads: a short word is one, a long word or
    text without blanks gives many, each as likely to be drawn. Rows with a null language, id or text are not learned from. With no row left the network has no
    languages, and every text is `und`.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    names = sorted(r[0] for r in rows.select(lang_col).distinct().collect())
    if not names:
        return LanguageNet([])
    nth = F.row_number().over(Window.partitionBy(lang_col).orderBy(F.xxhash64(id_col), id_col))  # cut to `sample` rows before they are shuffled
    drawn = rows.select(id_col, lang_col).withColumn("__nth", nth).where(F.col("__nth") <= sample)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, langs = [], []
            for text, lang in zip(textkit.as_text(batch.column(0)), batch.column(1).to_pylist()):
                every = [(piece, word) for word in text.as_py().lower().split() for piece in sequences(word)]
                for k in np.unique(np.linspace(0, len(every) - 1, words).astype(int)) if every else ():
                    if any(map(str.isalpha, every[k][1])):
                        taken.append(every[k][0])
                        langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(taken, pa.binary()), pa.array(langs, pa.string())], ["word", "lang"])

    taken = rows.join(F.broadcast(drawn.select(id_col).distinct()), id_col).select(F.col(text_col), F.col(lang_col).cast("string"))
    got = taken.mapInArrow(draw, "word binary, lang string").orderBy("word", "lang").toArrow()
    net = LanguageNet(names)
    place = {n: k for k, n in enumerate(names)}
    net.fit([bytes(w) for w in got["word"].to_pylist()], np.array([place[x] for x in got["lang"].to_pylist()], np.int64))
    return net


def identify_language(docs: DataFrame, net: LanguageNet, text_col: str = "text") -> DataFrame:
    """All columns of `docs` with `lang_pred` and `lang_score`; columns of these names are replaced.

    lang_score is the pooled probability of lang_pred, of equal ones the first name's. A text that is null or has no letter is `und`, score 0.
    Texts are read whole, in slices of about 4 MB of rows; rows that repeat give the same; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent, key = spark.sparkContext.broadcast(net), uuid.uuid4().hex
    rows = docs.drop("lang_pred", "lang_score")
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        known = worker_cache("language")
        if key not in known and net.names:
            known.clear()
            known[key] = Reader(net)
        reader = known.get(key)
        for batch in batches:
            text = textkit.as_text(batch.column(at))
            pooled = np.zeros((len(text), len(net.names) + 1))
            for a, b in textkit.slices(text, 4 << 20) if net.names else ():
                words = pc.utf8_split_whitespace(pc.utf8_lower(text.slice(a, b - a)))
                first = words.offsets.to_numpy()
                coded = words.flatten().dictionary_encode()
                sums = reader.of(coded.dictionary.to_pylist())
                which = coded.indices.to_numpy()
                for j in range(sums.shape[1]):
                    total = np.concatenate([[0.0], np.cumsum(sums[which, j])])
                    pooled[a:b, j] = total[first[1:] - first[0]] - total[first[:-1] - first[0]]
            share = pooled[:, :-1] / np.maximum(pooled[:, -1:], 1)
            known = pooled[:, -1] > 0.5
            best = share.argmax(axis=1) if net.names else np.zeros(len(text), int)
            names = [net.names[k] if ok else "und" for k, ok in zip(best, known)]
            score = np.where(known, np.clip(share.max(axis=1), 0, 1), 0.0) if net.names else np.zeros(len(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "lang_score"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, lang_score double")
