"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

The model at hand merges pairs (BPE). A segmentation is the one that merging gives if and only if each two
neighbouring pieces are what merging gives for the two of them alone: the first merge across a border of a
segmentation would also happen if only the two pieces beside that border were there. Encoding thus is a path search: a state is
the piece just read, a step to the next piece weighs -1 if the two agree and minus infinity if not, and
exactly one path is finite. That is the max-plus form of the usual Viterbi search, with the library's own
ids as its result.

A document beyond CHUNK characters is cut anywhere. For each chunk a transfer matrix gives the best weight
from each piece that may lie over its left cut to each that may lie over its right cut. Matrices are combined by
an associative scan into the pieces over all cuts, and then each chunk is traced back on its own.

No piece runs on from other characters into the blank sign, so before it all paths meet; a chunk's paths
part only up to there. Ordinary documents are cut at these places into parts, and the distinct parts of a slice are
merged together by `Merger`, one merge of every part at a time, in numpy. Nothing is remembered between slices.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abridge.llm import textkit
from abridge.llm.common import small_batches, stored, worker_cache

#: Characters of a chunk; a longer document is a giant.
CHUNK = 32_768
#: Answers of `Model.agree` remembered by a worker at most, about 100 bytes each.
REMEMBERED = 200_000
#: Parts up to so many characters are merged; longer ones are a path search, as merging is quadratic in the length.
SHORT = 48
BLANK = "▁"
_PART = re.compile("▁*[^▁]+|▁+")
_ROOT = -1


class Merger:
    """Merging for many parts at once: in each round the best pair of every part that has one is merged.

    Units are the pieces and, below them, single characters that occur in pieces only; other characters are negative
    (-2 - code point) and never merge. What two units merge to is looked up in an open-addressing hash table.
    """

    def __init__(self, ids: dict[str, int], rank: dict[str, float]):
        self.units = list(ids) + sorted({c for p in ids for c in p} - ids.keys())
        number = {u: k for k, u in enumerate(self.units)}
        self.ids = np.array([ids.get(u, -2 - ord(u[0])) for u in self.units], np.int64)
        score = np.array([rank.get(u, -np.inf) for u in self.units])
        self.order = np.unique(-score, return_inverse=True)[1].astype(np.int64)  # equal scores stay equal
        self.of_char = -2 - np.arange(0x110000, dtype=np.int32)
        for u, k in number.items():
            if len(u) == 1:
                self.of_char[ord(u)] = k
        pairs = [(number[p[:j]] << 20 | number[p[j:]], number[p]) for p in ids for j in range(1, len(p)) if p[:j] in number and p[j:] in number]
        self.mask = (1 << max(4, 2 * len(pairs)).bit_length()) - 1
        self.keys, self.made = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        if pairs:
            keys, made = np.array(pairs, np.int64).T
            slot = self._slot(keys)
            while len(keys):
                free = self.keys[slot] < 0
                _, lead = np.unique(slot[free], return_index=True)
                put = np.flatnonzero(free)[lead]
                self.keys[slot[put]], self.made[slot[put]] = keys[put], made[put]
                rest = np.ones(len(keys), bool)
                rest[put] = False
                keys, made, slot = keys[rest], made[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.int64(-7046029254386353131)) >> np.int64(24)) & self.mask

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What pairs of units merge to, -1 for nothing."""
        keys = a.astype(np.int64) << 20 | b
        keys[(a < 0) | (b < 0)] = -2
        slot, out = self._slot(keys), np.full(len(keys), -1, np.int32)
        there = self.keys[slot]
        hit = there == keys
        out[hit] = self.made[slot[hit]]
        left = np.flatnonzero(~hit & (there >= 0) & (keys >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.made[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out

    def units_of(self, text: str, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of the parts that lie end to end in `text`, `size` characters each (none empty), and how many each part has."""
        unit = self.of_char[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        first = np.cumsum(size) - size
        own = np.repeat(np.arange(len(size), dtype=np.int32), size)
        pair = np.full(len(unit), -1, np.int32)  # what a unit and the next of its part merge to
        if len(unit):
            pair[:-1] = self._merged(unit[:-1], unit[1:])
            pair[first[1:] - 1] = -1
        out, owners, never = [], [], np.iinfo(np.int64).max
        while len(unit):
            place = np.arange(len(unit)) - np.repeat(first, np.diff(np.append(first, len(unit))))
            cost = np.where(pair >= 0, self.order[pair] << 16 | place, never)
            best = np.minimum.reduceat(cost, first)
            ended = best == never
            if ended.any():
                done = np.repeat(ended, np.diff(np.append(first, len(unit))))
                out.append(unit[done])
                owners.append(own[done])
                unit, own, pair, best = unit[~done], own[~done], pair[~done], best[~ended]
                if not len(unit):
                    break
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            at = first + (best & 0xFFFF)
            unit[at] = pair[at]
            keep = np.ones(len(unit), bool)
            keep[at + 1] = False
            unit, own, pair = unit[keep], own[keep], pair[keep]
            at = at - np.arange(len(at))  # each part has lost one unit
            first = first - np.arange(len(first))
            for k in (at, at[at > first] - 1):
                inside = k + 1 < len(unit)
                k = k[inside]
                same = own[k] == own[k + 1]
                pair[k] = np.where(same, self._merged(unit[k], unit[k + 1]), -1)
            pair[-1] = -1
        if not out:
            return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
        unit, own = np.concatenate(out), np.concatenate(owners)
        order = np.argsort(own, kind="stable")
        return unit[order], np.bincount(own, minlength=len(size))


class Model:
    """Pieces of a SentencePiece BPE model with byte fallback, and the path search over them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.rank[piece] = sp.get_score(i)
        self.most = max(map(len, self.ids))
        self.begun = {p[:k] for p in self.ids for k in range(1, len(p))}
        self.meets = not any(re.search("[^▁]▁", p) for p in self.ids)
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.agreed: dict[int, bool] = {}
        self.merger = Merger(self.ids, self.rank)
        # What each id reads as, end to end; the blank sign as a blank.
        read = [bytes([self.of_byte[i]]) if i in self.of_byte else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        self.read_size = np.fromiter(map(len, read), np.int64, len(read))
        self.read, self.read_at = np.frombuffer(b"".join(read), np.uint8), np.cumsum(self.read_size) - self.read_size

    def merged(self, text: str) -> list[str]:
        """Pieces by merging the neighbours of best score, the left ones first among equals: the definition."""
        parts = list(text)
        while True:
            best, at = -np.inf, -1
            for k in range(len(parts) - 1):
                score = self.rank.get(parts[k] + parts[k + 1])
                if score is not None and score > best:
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def agree(self, a: int, b: int) -> bool:
        """Whether merging leaves the two pieces as they are, side by side."""
        if a < 0 or b < 0:
            return True
        key = a << 20 | b
        found = self.agreed.get(key)
        if found is None:
            if len(self.agreed) > 2 * REMEMBERED:
                self.agreed.clear()
            x, y = self.pieces[a], self.pieces[b]
            found = self.agreed[key] = self.merged(x + y) == [x, y]
        return found

    def _steps(self, s: str, i: int) -> Iterator[tuple[int, int]]:
        """(end, piece) of the pieces that begin at i; a character without a piece is one of its own, negative."""
        if s[i] not in self.ids:
            yield i + 1, -2 - ord(s[i])
        for j in range(i + 1, min(len(s), i + self.most) + 1):
            part = s[i:j]
            found = self.ids.get(part)
            if found is not None:
                yield j, found
            if part not in self.begun:
                return

    def search(self, s: str, start: int, piece: int, stop: int) -> dict[int, tuple[int, int, int]]:
        """From `piece` ending at `start`: end -> (piece that ends there, its begin, pieces so far), for steps that begin before `stop`."""
        reach = {start: (piece, start, 0)}
        for i in range(start, stop):
            if i not in reach:
                continue
            last, _, count = reach[i]
            for j, found in self._steps(s, i):
                if j not in reach and self.agree(last, found):
                    reach[j] = (found, i, count + 1)
        return reach

    def _path(self, s: str, start: int, piece: int, goal: int) -> list[int]:
        """Pieces from `start`, where `piece` ends, to `goal`."""
        reach, path, j = self.search(s, start, piece, goal), [], goal
        while j > start:
            found, j, _ = reach[j]
            path.append(found)
        return path[::-1]

    def _borders(self, s: str, low: int, high: int) -> tuple[int, int] | None:
        """The first and the last place in [low, high) where all paths meet."""
        if not self.meets:
            return None
        places = [k for k in range(max(low, 1), high) if s[k] == BLANK and s[k - 1] != BLANK]
        return (places[0], places[-1]) if places else None

    def _ids(self, pieces: list[int]) -> list[int]:
        out = []
        for p in pieces:
            if p >= 0:
                out.append(p)
            else:
                out += [self.bytes[b] for b in chr(-2 - p).encode()]
        return out

    def ragged(self, text: str, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts that lie end to end in `text`, and how many each has."""
        whole = size <= SHORT
        if whole.all():
            return self._numbered(*self.merger.units_of(text, size))
        ends = np.cumsum(size).tolist()
        long = [(ends[k] - int(size[k]), ends[k]) for k in np.flatnonzero(~whole).tolist()]
        between = "".join(text[i:j] for i, j in zip([0, *(e for _, e in long)], [*(b for b, _ in long), len(text)]))
        apart = [self._ids(self._path(text[b:e], 0, _ROOT, e - b)) for b, e in long]
        ids, some = self._numbered(*self.merger.units_of(between, size[whole]))
        many = np.zeros(len(size), np.int64)
        many[whole], many[~whole] = some, list(map(len, apart))
        out, short = np.empty(int(many.sum()), np.int32), np.repeat(whole, many)
        out[short], out[~short] = ids, [i for part in apart for i in part]
        return out, many

    def _numbered(self, units: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units; characters without a piece become the ids of their bytes."""
        ids = np.where(units >= 0, self.merger.ids[np.maximum(units, 0)], units)
        odd = ids < 0
        if not odd.any():
            return ids.astype(np.int32), many
        codes, which = np.unique(ids[odd], return_inverse=True)
        each = [self._ids([c]) for c in codes.tolist()]
        size = np.ones(len(ids), np.int64)
        size[odd] = np.array([len(e) for e in each])[which]
        out = np.repeat(ids, size).astype(np.int32)
        out[np.repeat(odd, size)] = np.fromiter((i for k in which.tolist() for i in each[k]), np.int32)
        owner = np.repeat(np.arange(len(many)), many)
        return out, np.bincount(owner, weights=size, minlength=len(many)).astype(np.int64)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids read as, end to end."""
        size = self.read_size[ids]
        return self.read[np.repeat(self.read_at[ids] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]

    def inside(self, s: str) -> np.ndarray:
        """Ids of a stretch that begins and ends where all paths meet."""
        parts = _PART.findall(s)
        return self.ragged(s, np.fromiter(map(len, parts), np.int64, len(parts)))[0] if parts else np.zeros(0, np.int32)

    def parts(self, text: str) -> list[str]:
        """A text with its blank sign in front, cut where all paths meet."""
        s = signed(text)
        return _PART.findall(s) if self.meets else [s] if s else []

    def encode(self, text: str) -> list[int]:
        parts = self.parts(text)
        return self.ragged("".join(parts), np.fromiter(map(len, parts), np.int64, len(parts)))[0].tolist() if parts else []

    def decode(self, ids) -> str:
        """The text of ids: bytes as bytes, blank signs as blanks, without the one in front."""
        data = b"".join(bytes([self.of_byte[i]]) if i in self.of_byte else self.pieces[i].replace(BLANK, " ").encode() for i in ids)
        text = data.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    # Chunks. `s` is a chunk with up to most - 1 characters of its neighbours; it lies at [a, b) in s.

    def over(self, s: str, cut: int) -> list[tuple[int, int, int]]:
        """(begin, end, piece) relative to the cut, of all pieces that begin before it and end on or after it."""
        found = []
        for i in range(max(0, cut - self.most + 1), cut):
            found += [(i - cut, j - cut, p) for j, p in self._steps(s, i) if j >= cut]
        return sorted(found)

    def entries(self, s: str, a: int, first: bool) -> list[tuple[int, int, int]]:
        return [(0, 0, _ROOT)] if first else self.over(s, a)

    def exits(self, s: str, b: int, last: bool) -> list[tuple[int, int, int]]:
        return [x for x in self.over(s, b) if x[1] == 0] if last else self.over(s, b)

    def transfer(self, s: str, a: int, b: int, first: bool, last: bool) -> np.ndarray:
        """Weights from each entry to each exit: minus the pieces (ids, inside) that begin in the chunk, or minus infinity."""
        entries, exits = self.entries(s, a, first), self.exits(s, b, last)
        at = {(i + b, p): k for k, (i, _, p) in enumerate(exits)}
        weights = np.full((len(entries), len(exits)), -np.inf)
        far = max((a + e for _, e, _ in entries), default=a)
        meet, last_meet = self._borders(s, far, b) or (None, None)
        rest = {}
        if meet is not None:  # whole parts between the borders, paths only beyond them
            inside = len(self.inside(s[meet:last_meet]))
            rest = {k: w - inside for k, w in self._leaving(s, last_meet, _ROOT, b, at).items()}
        for row, (i, e, p) in enumerate(entries):
            if a + e >= b:  # it lies over all of a short chunk
                if (a + i, p) in at and (not last or a + e == b):
                    weights[row, at[a + i, p]] = 0
                continue
            if meet is not None:
                reach = self.search(s, a + e, p, meet)
                if meet in reach:
                    for k, w in rest.items():
                        weights[row, k] = w - reach[meet][2]
            else:
                for k, w in self._leaving(s, a + e, p, b, at).items():
                    weights[row, k] = w
        return weights

    def _leaving(self, s: str, start: int, piece: int, b: int, at: dict) -> dict[int, float]:
        out, reach = {}, {start: (piece, 0)}
        for i in range(start, b):
            if i not in reach:
                continue
            last, count = reach[i]
            for j, found in self._steps(s, i):
                if self.agree(last, found):
                    if j < b:
                        reach.setdefault(j, (found, count + 1))
                    elif (i, found) in at:
                        out[at[i, found]] = -(count + 1.0)
        return out

    def trace(self, s: str, a: int, b: int, entry: tuple[int, int, int], leave: tuple[int, int, int]) -> list[int]:
        """Ids of the pieces that begin in [a, b), between the known pieces over both cuts."""
        start, goal = a + entry[1], b + leave[0]
        if goal < a:
            return []
        meet, last_meet = self._borders(s, start, goal) or (None, None)
        if meet is None:
            return self._ids([*self._path(s, start, entry[2], goal), leave[2]])
        return self._ids(self._path(s, start, entry[2], meet)) + self.inside(s[meet:last_meet]).tolist() + self._ids([*self._path(s, last_meet, _ROOT, goal), leave[2]])


def signed(text: str) -> str:
    return BLANK + text.replace(" ", BLANK) if text else ""


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Max-plus product of two transfer matrices."""
    if not x.shape[1]:
        return np.full((len(x), y.shape[1]), -np.inf)
    return (x[:, :, None] + y[None, :, :]).max(axis=1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, in a number of rounds that grows with the logarithm of their count."""
    if len(matrices) == 1:
        return matrices
    pairs = scan([product(matrices[k], matrices[k + 1]) for k in range(0, len(matrices) - 1, 2)])
    out = [matrices[0]]
    for k in range(1, len(matrices)):
        out.append(pairs[k // 2] if k % 2 else product(pairs[k // 2 - 1], matrices[k]))
    return out


def crossings(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(entry, exit) of each chunk on the one path of finite weight."""
    ahead = scan(matrices)
    behind = [m.T for m in scan([m.T for m in matrices[::-1]])[::-1]]
    states = [0]
    for k in range(1, len(matrices)):
        states.append(int((ahead[k - 1][0] + behind[k].max(axis=1)).argmax()))
    states.append(int(ahead[-1][0].argmax()))
    return list(zip(states[:-1], states[1:]))


def model(path: str) -> Model:
    known = worker_cache("sentencepieces")
    if path not in known:
        known.clear()
        known[path] = Model(path)
    return known[path]


def _flags(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def _table(m: Model, words: pa.Array, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the plain ones of distinct words, each with a blank sign before it, end to end; how many a word has; whether they read as the word."""
    size, fits = np.zeros(len(words), np.int64), np.ones(len(words), bool)
    chosen = words.filter(pa.array(plain))
    if not len(chosen):
        return np.zeros(0, np.int32), size, fits
    text = BLANK + BLANK.join(chosen.to_pylist())
    ids, many = m.ragged(text, pc.utf8_length(chosen).to_numpy().astype(np.int64) + 1)
    size[plain] = many
    want, got = np.frombuffer(text.replace(BLANK, " ").encode(), np.uint8), m.bytes_of(ids)
    ends = np.append(0, np.cumsum(pc.binary_length(chosen).to_numpy().astype(np.int64) + 1))
    read = np.append(0, np.cumsum(m.read_size[ids]))[np.append(0, np.cumsum(many))]
    if len(want) != len(got) or (ends != read).any() or (want != got).any():
        same = [got[read[k] : read[k + 1]].tobytes() == want[ends[k] : ends[k + 1]].tobytes() for k in range(len(chosen))]
        fits[plain] = same
    return ids, size, fits


def _small(batches: Iterator[pa.RecordBatch], path: str, at: int) -> Iterator[pa.RecordBatch]:
    """Batches with their ids and whether decoding gives the text again. Distinct parts are encoded once."""
    m = model(path)
    for batch in batches:
        column, ids_out, fits_out = textkit.as_text(batch.column(at)), [], []
        for a, b in textkit.slices(column, 2 << 20):
            text = column.slice(a, b - a)
            lists = pc.split_pattern(text, " ")
            first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            coded = lists.flatten().dictionary_encode()
            which, words = coded.indices.to_numpy(), coded.dictionary
            plain = (~_flags(pc.match_substring(words, BLANK)) & (pc.utf8_length(words).to_numpy() > 0)) if m.meets else np.zeros(len(words), bool)
            flat, size, fits = _table(m, words, plain)
            whole = plain[which]
            start, many = np.cumsum(size) - size, size[which]
            ids = flat[np.repeat(start[which] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
            ends = np.append(0, np.cumsum(many))[first]
            bad = np.add.reduceat(~whole, first[:-1]) > 0
            right = np.add.reduceat(~fits[which], first[:-1]) == 0
            if bad.any():  # runs of blanks, empty texts, blank signs
                own = [ids[ends[k] : ends[k + 1]] if not bad[k] else np.array(m.encode(text[k].as_py()), np.int32) for k in range(len(text))]
                for k in np.flatnonzero(bad):
                    right[k] = m.decode(own[k].tolist()) == text[k].as_py()
                ids, ends = np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
            ids_out.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32())))
            fits_out.append(pa.array(right))
        ids = pa.concat_arrays(ids_out) if ids_out else pa.array([], pa.list_(pa.int32()))
        fits = pa.concat_arrays(fits_out) if fits_out else pa.array([], pa.bool_())
        yield pa.RecordBatch.from_arrays([*batch.columns, ids, fits], [*batch.schema.names, "piece_ids", "round_trip"])


def _cut(batches: Iterator[pa.RecordBatch], chunk: int, beside: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            s = signed(text.as_py())
            count = -(-len(s) // chunk)
            for k in range(count):
                a, b = k * chunk, min(len(s), (k + 1) * chunk)
                low = max(0, a - beside)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()]), pa.array([k], pa.int32()), pa.array([count], pa.int32()), pa.array([s[low : b + beside]]), pa.array([a - low], pa.int32()), pa.array([b - low], pa.int32())], ["key", "k", "count", "s", "a", "b"])


def _giants(docs: DataFrame, path: str, text_col: str, chunk: int) -> DataFrame:
    """(key, piece_ids) of the distinct texts of `docs`."""
    spark = docs.sparkSession
    texts = docs.select(F.sha2(text_col, 256).alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"])
    beside = model(path).most - 1
    chunks = stored(texts.mapInArrow(lambda b: _cut(b, chunk, beside), "key string, k int, count int, s string, a int, b int").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "chunks")

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            rows = (row for at in range(0, batch.num_rows, 64) for row in batch.slice(at, 64).to_pylist())
            got = [m.transfer(r["s"], r["a"], r["b"], r["k"] == 0, r["k"] == r["count"] - 1) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(g) for g in got], pa.int32()), pa.array([g.tobytes() for g in got], pa.binary())], ["key", "k", "entries", "weights"])

    def combine(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        found = crossings([np.frombuffer(w, np.float64).reshape(n, -1) for n, w in zip(group["entries"], group["weights"])])
        return pd.DataFrame({"key": group["key"], "k": group["k"], "entry": [f[0] for f in found], "leave": [f[1] for f in found]})

    # A matrix stands for `chunk` characters, so a document's matrices are a small part of its size.
    matrices = chunks.mapInArrow(transfers, "key string, k int, entries int, weights binary")
    borders = matrices.groupBy("key").applyInPandas(combine, "key string, k int, entry int, leave int")

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            ids = []
            for r in (row for at in range(0, batch.num_rows, 64) for row in batch.slice(at, 64).to_pylist()):
                entry = m.entries(r["s"], r["a"], r["k"] == 0)[r["entry"]]
                leave = m.exits(r["s"], r["b"], r["k"] == r["count"] - 1)[r["leave"]]
                ids.append(np.array(m.trace(r["s"], r["a"], r["b"], entry, leave), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["key", "k", "ids"])

    traced = chunks.join(borders, ["key", "k"]).select("key", "k", "count", "s", "a", "b", "entry", "leave").mapInArrow(traces, "key string, k int, ids array<int>")
    return traced.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("all")).select("key", F.flatten(F.col("all.ids")).alias("piece_ids"))


def encode_pieces(docs: DataFrame, path: str, text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """All columns of `docs` with `piece_ids` and `round_trip`; columns of these names are replaced.

    piece_ids are those of the sentencepiece library for the BPE model at `path`. Null and empty texts have none. round_trip tells
    whether decoding gives the text again; it does unless the text holds the blank sign U+2581 itself,
    which the model reads as a blank.
    """
    small_batches(docs.sparkSession)
    rows = docs.drop("piece_ids", "round_trip")
    at = rows.columns.index(text_col)
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    schema = f"{kinds}, piece_ids array<int>, round_trip boolean"
    giant = F.coalesce(F.char_length(text_col) > chunk, F.lit(False))
    small = rows.where(~giant).mapInArrow(lambda b: _small(b, path, at), schema)
    large = rows.where(giant)
    found = _giants(large, path, text_col, chunk)
    large = large.withColumn("__key", F.sha2(text_col, 256)).join(found.withColumnRenamed("key", "__key"), "__key").select(*rows.columns, "piece_ids")

    width = len(rows.columns)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            fits = [m.decode(ids.as_py()) == text.as_py() for ids, text in zip(batch.column(width), batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fits, pa.bool_())], [*batch.schema.names, "round_trip"])

    return small.union(large.mapInArrow(check, schema))


def decode_pieces(encoded: DataFrame, path: str, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """All columns of `encoded` with the text of its ids; null ids give null."""
    rows = encoded.drop(text_col)
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [None if ids is None else m.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, `{text_col}` string")
