"""Token ids packed into rows of fixed length by best fit decreasing, as little-endian binary matrices.

Texts are encoded, split losslessly into segments of at most `length` ids, and packed: segments in
decreasing size, each into the open row with the least room that holds it. A segment tree over
capacities answers that search. Packing windows hold WINDOW ids, so memory is bounded, nothing
is shuffled, and a lost task is redone from its own input. Each window leaves one badly filled row or so
(below 0.1 % of the ids).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abridge.llm import textkit
from abridge.llm.common import small_batches
from abridge.llm.pieces import pieces

#: Ids in a packing window.
WINDOW = 4_000_000


class Rooms:
    """Open rows by room left: a segment tree over room sizes, each leaf a stack of rows with just that room."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.full = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        k = room + self.leaves
        while k and not self.full[k]:
            self.full[k] = 1
            k >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The row with the least room of at least `size`, and its room; it is no longer open."""
        k = size + self.leaves
        if not self.full[k]:
            while True:  # up while there is nothing to the right, then down along the left
                while k & 1:
                    k >>= 1
                    if not k:
                        return None
                if self.full[k + 1]:
                    k += 1
                    break
                k >>= 1
                if k <= 1:
                    return None
            while k < self.leaves:
                k = 2 * k if self.full[2 * k] else 2 * k + 1
        room = k - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.full[k] = 0
            k >>= 1
            while k and not (self.full[2 * k] or self.full[2 * k + 1]):
                self.full[k] = 0
                k >>= 1
        return row, room


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Rows of segment numbers; sizes are 1 to `length`. Ties keep their order."""
    rooms, rows = Rooms(length), []
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        found = rooms.take(size)
        if found is None:
            rows.append([k])
            left = length - size
            row = len(rows) - 1
        else:
            row, room = found
            rows[row].append(k)
            left = room - size
        if left:
            rooms.put(left, row)
    return rows


def _gather(which: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of parts in order, and where each part's begin."""
    many = size[which]
    at = np.cumsum(many) - many
    return ids[np.repeat(start[which] - at, many) + np.arange(int(many.sum()))], np.append(at, int(many.sum()))


def pack_token_ids(docs: DataFrame, tokenizer: str, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", pad: int = 0, end: int | None = None) -> DataFrame:
    """Packed rows: row_id, n_ids, input_ids, positions, cu_seqlens, doc_ids, doc_offsets, id_bytes.

    input_ids: `length` little-endian unsigned ids of id_bytes (2 or 4) bytes each, padded with `pad` after n_ids.
    cu_seqlens: 0, then the end of each segment; positions: two bytes (four beyond 65,536) for each id,
    starting again from 0 at each segment, 0 in the padding. doc_ids and doc_offsets name the document of each segment and
    where in its ids the segment begins, so every document can be put together again. `end`, if given,
    follows each document's ids. Null and empty texts give no ids and no segment (but `end`). Rows that
    repeat an id are packed each; a null id is kept as null. row_id is unique and the same when a task is
    run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(tokenizer)
        kind = np.uint16 if known.whole.get_vocab_size() <= 65536 else np.uint32
        place = np.dtype(np.uint16 if length <= 65536 else np.uint32)
        task, written = TaskContext.get().partitionId() << 33, 0
        ramp = np.arange(length, dtype=place)

        def packed(names: list, flats: list, ends: list) -> Iterator[pa.RecordBatch]:
            nonlocal written
            flat = np.concatenate(flats)
            whole = np.diff(np.concatenate([[0], *ends]))
            begin = np.cumsum(whole) - whole
            pieces_of = -(-whole // length)
            doc = np.repeat(np.arange(len(whole)), pieces_of)
            offset = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of)) * length
            size = np.minimum(length, whole[doc] - offset)
            source = begin[doc] + offset
            owner = pa.concat_arrays(names)
            rows = best_fit_decreasing(size, length)
            for at in range(0, len(rows), 512):
                some = rows[at : at + 512]
                matrix, places = np.full((len(some), length), pad, kind), np.zeros((len(some), length), place)
                cuts, total = [], []
                for r, row in enumerate(some):
                    k, cut = 0, [0]
                    for s in row:
                        n = int(size[s])
                        matrix[r, k : k + n] = flat[source[s] : source[s] + n]
                        places[r, k : k + n] = ramp[:n]
                        k += n
                        cut.append(k)
                    cuts.append(cut)
                    total.append(k)
                members = np.concatenate(some)
                lists = np.concatenate([[0], np.cumsum([len(r) for r in some])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(written, written + len(some)) + task),
                        pa.array(total, pa.int32()),
                        pa.array([m.tobytes() for m in matrix], pa.binary()),
                        pa.array([m.tobytes() for m in places], pa.binary()),
                        pa.array(cuts, pa.list_(pa.int32())),
                        pa.ListArray.from_arrays(pa.array(lists), owner.take(pa.array(doc[members]))),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(offset[members])),
                        pa.array(np.full(len(some), np.dtype(kind).itemsize, np.int32)),
                    ],
                    ["row_id", "n_ids", "input_ids", "positions", "cu_seqlens", "doc_ids", "doc_offsets", "id_bytes"],
                )
                written += len(some)

        names, flats, ends, held = [], [], [], 0
        for batch in batches:
            text, at = textkit.as_text(batch.column(1)), 0
            for which, ids, start, size, first in known.ragged(text):
                if end is not None:
                    which, first = np.insert(which, first[1:], len(size)), first + np.arange(len(first))
                    ids, start, size = np.append(ids, end), np.append(start, len(ids)), np.append(size, 1)
                flat, starts = _gather(which, ids.astype(kind), start, size)
                names.append(batch.column(0).slice(at, len(first) - 1))
                at += len(first) - 1
                flats.append(flat)
                ends.append(held + starts[first[1:]])
                held += len(flat)
                if held >= WINDOW:
                    yield from packed(names, flats, ends)
                    names, flats, ends, held = [], [], [], 0
        if names:
            yield from packed(names, flats, ends)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col))
    kind = dict(rows.dtypes)[id_col]
    schema = f"row_id long, n_ids int, input_ids binary, positions binary, cu_seqlens array<int>, doc_ids array<{kind}>, doc_offsets array<long>, id_bytes int"
    return rows.mapInArrow(run, schema)


def as_matrix(rows: list, column: str = "input_ids", length: int = 2048) -> np.ndarray:
    """Collected packed rows as one matrix."""
    width = len(rows[0][column]) // length if rows else 2
    return np.frombuffer(b"".join(r[column] for r in rows), f"<u{width}").reshape(len(rows), length)


def write_packed(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    """Write packed rows as Parquet."""
    pack_token_ids(docs, tokenizer, **options).write.option("compression", "zstd").parquet(path)
