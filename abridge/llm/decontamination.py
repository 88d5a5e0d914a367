"""Benchmark decontamination: pigeonhole pieces found exactly, verified by Myers' bit-parallel distance.

Texts and test items are read as words, letters and digits only, A-Z lower-cased. An item of m words may be met with up to
e = floor(share * m) word edits (substituted, missing or extra words). Cut into e + 1 pieces, one of them is then met unchanged, so exact hits of
pieces, by hash, give all candidates. Each candidate window is verified with Myers' algorithm over
words, one bit for each word of the item.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from abridge.llm import textkit
from abridge.llm.common import small_batches

#: Bytes of test items in one pass over the documents: what is sent to the executors at once. More items make more passes.
PASS_BYTES = 8 << 20
SHARE = 0.2
_FILTER = 22


def budget(words: int, share: float = SHARE) -> int:
    return int(share * words)


def cut_points(words: int, errors: int) -> list[int]:
    """Borders of errors + 1 pieces, whose lengths differ by one at most."""
    return [k * words // (errors + 1) for k in range(errors + 2)]


def myers(pattern: list[int], text: list[int], anchored: bool = False) -> tuple[int, int]:
    """Least edit distance between the pattern and any run of the text (if anchored, any that begins with it), and where the first such run ends."""
    m = len(pattern)
    equal: dict[int, int] = defaultdict(int)
    for k, w in enumerate(pattern):
        equal[w] |= 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        eq = equal.get(w, 0)
        x = eq | down
        d = ((((eq & up) + up) ^ up) | eq) & full
        plus, minus = down | (~(d | up) & full), up & d
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1 | anchored) & full, (minus << 1) & full
        up, down = minus | (~(x | plus) & full), plus & x
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass
class Items:
    """Test items with an index of their pieces by length and hash."""

    ids: list
    words: list[np.ndarray]
    share: float

    def __post_init__(self):
        pieces = defaultdict(list)
        for item, words in enumerate(self.words):
            cuts = cut_points(len(words), budget(len(words), self.share))
            for a, b in zip(cuts, cuts[1:]):
                pieces[b - a].append((int(textkit.gram_hashes(words[a:b], b - a)[0]), item, a))
        self.index = {}
        for size, rows in pieces.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            seen = np.zeros(1 << _FILTER, bool)
            seen[keys >> np.uint64(64 - _FILTER)] = True
            self.index[size] = (seen, keys, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        self.lists = [w.tolist() for w in self.words]

    def hits(self, words: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, end word) for each item that a text holds within its budget, at its best place."""
        found = []
        for size, (seen, keys, items, offsets) in self.index.items():
            grams = textkit.gram_hashes(words, size)
            place = np.flatnonzero(seen[grams >> np.uint64(64 - _FILTER)])
            low, high = (np.searchsorted(keys, grams[place], side) for side in ("left", "right"))
            text = np.searchsorted(of, place, "right") - 1
            ok = (high > low) & (place + size <= of[text + 1])
            place, low, high, text = place[ok], low[ok], high[ok], text[ok]
            many = high - low
            k = np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            found.append(np.stack([np.repeat(text, many), items[k], np.repeat(place, many) - offsets[k]], axis=1))
        rows = np.concatenate(found) if found else np.zeros((0, 3), int)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        k = 0
        while k < len(rows):
            text, item = int(rows[k, 0]), int(rows[k, 1])
            end = k
            while end < len(rows) and rows[end, 0] == text and rows[end, 1] == item:
                end += 1
            m = len(self.lists[item])
            e = budget(m, self.share)
            best = None
            while k < end:  # starts that lie close share a window
                first = last = int(rows[k, 2])
                while k < end and rows[k, 2] - last <= e + 1:
                    last = int(rows[k, 2])
                    k += 1
                a, b = max(int(of[text]), first - e), min(int(of[text + 1]), last + m + e)
                distance, to = myers(self.lists[item], words[a:b].tolist())
                if distance <= e and (best is None or distance < best[2]):
                    base = int(of[text])
                    # Where the run begins: the pattern backwards from its end.
                    _, size = myers(self.lists[item][::-1], words[a : a + to][::-1].tolist(), True)
                    best = (text, item, distance, a + to - size - base, a + to - base)
            if best:
                yield best


def _passes(benchmark: DataFrame, id_col: str, text_col: str, share: float) -> Iterator[Items]:
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // PASS_BYTES)
    for k in range(passes):
        some = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == k).orderBy("id", "text").collect()
        text = textkit.as_text(pa.array([r["text"] for r in some], pa.string()))
        words, of = textkit.word_hashes(text, textkit.NOT_WORD)
        items = [(r["id"], words[of[i] : of[i + 1]]) for i, r in enumerate(some) if of[i + 1] > of[i]]
        yield Items([i for i, _ in items], [w for _, w in items], share)


def contaminations(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, distance, budget, first_word, end_word) for each document and item that it holds within the item's budget.

    An item's place is given once, where its distance is least. Null and blank texts or items give nothing; an item without an id is searched too, its item id is null. Items under 1 / share words
    must be met exactly. Rows that repeat an id each give their rows. Texts are read whole, a text longer than a slice alone; empty
    tables give no rows. Where both id columns have one name, the item's is called `benchmark_` and its name. Items are
    sent in passes of PASS_BYTES, each a scan of the documents; nothing else grows with the benchmark.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col))
    if item_col == id_col:
        benchmark, item_col = benchmark.withColumnRenamed(item_col, f"benchmark_{item_col}"), f"benchmark_{item_col}"
    kind, item_kind = dict(rows.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, distance int, budget int, first_word int, end_word int"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _passes(benchmark, item_col, item_text_col, share):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                text = textkit.as_text(batch.column(1))
                got = []
                for a, b in textkit.slices(text):
                    got += [(a + h[0], *h[1:]) for h in items.hits(*textkit.word_hashes(text.slice(a, b - a), textkit.NOT_WORD))]
                cells = [pa.array([h[k] for h in got], pa.int32()) for k in range(5)]
                names = pa.array([items.ids[h[1]] for h in got], item_type)
                most = pa.array([budget(len(items.lists[h[1]]), items.share) for h in got], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(cells[0]), names, cells[2], most, cells[3], cells[4]], [id_col, item_col, "distance", "budget", "first_word", "end_word"])

        out = out.union(rows.mapInArrow(run, schema))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that hold no item within its budget. Nothing is shuffled."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    for items in _passes(benchmark, item_col, item_text_col, share):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                text = textkit.as_text(batch.column(at))
                keep = np.ones(len(text), bool)
                for a, b in textkit.slices(text):
                    for h in items.hits(*textkit.word_hashes(text.slice(a, b - a), textkit.NOT_WORD)):
                        keep[a + h[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
