"""Word splitting and hashing of Arrow text columns with numpy, whole batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Large buffers go back to the system when they are freed, not into a pool of the worker's own.
pa.set_memory_pool(pa.system_memory_pool())

WIDTH = 64
_rng = np.random.Generator(np.random.PCG64(20240229))
#: Tabulation hashing: one random 64-bit value for each (position, byte).
_TABLE = _rng.integers(0, 2**64, size=WIDTH * 256, dtype=np.uint64)
#: One odd multiplier for each place in a shingle.
_PLACES = _rng.integers(0, 2**64, size=64, dtype=np.uint64) | np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
#: All of ASCII but letters and digits.
NOT_WORD = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(text: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text makes a range of its own."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
        yield at, min(end, len(text))
        at = end


def as_text(column: pa.Array) -> pa.Array:
    """Large strings, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each text begins and ends in them."""
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, runs of bytes not in `between`: first byte, end byte, first word of each text (one more at the end), blank flags."""
    blank = between[data]
    word = ~blank
    first = word.copy()
    first[1:] &= blank[:-1]
    edges = at[:-1][at[:-1] < len(data)]
    first[edges] = word[edges]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= blank[1:]
    ends = at[1:][at[1:] > 0] - 1
    last[ends] = word[ends]
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at), blank


def word_hashes(text: pa.Array, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word after lower-casing A-Z, and the first word of each text (one more at the end)."""
    data, at = raw(text)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    starts, _, of, blank = word_spans(data, at, between)
    if not len(starts):
        return np.zeros(0, np.uint64), of
    run = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), run)
    body = data[starts[0] :]
    value = _TABLE.take(((place & (WIDTH - 1)) << 8) | _LOWER.take(body))
    if run.max() > WIDTH and (far := place >= WIDTH).any():
        value[far] *= mix((place[far] // WIDTH).astype(np.uint64)) | np.uint64(1)
    value[blank[starts[0] :]] = 0
    return mix(np.add.reduceat(value, starts - starts[0])), of


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words, text borders ignored."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = words[: len(words) - n + 1] * _PLACES[0]
    for k in range(1, n):
        total = total + words[k : len(words) - n + 1 + k] * _PLACES[k]
    return mix(total + mix(np.full(1, n, np.uint64)))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values. (np.unique takes a slower way for integers.)"""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def shingle_sets(text: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """For each text its set of n-word shingles, as sorted hashes.

    With fewer words the whole sequence is one shingle; without words the set is empty.
    Two different shingles share a hash with probability 2**-64.
    """
    words, of = word_hashes(text)
    grams = gram_hashes(words, n)
    for i in range(len(text)):
        a, b = int(of[i]), int(of[i + 1])
        if b - a >= n:
            yield distinct(grams[a : b - n + 1])
        elif b > a:
            yield gram_hashes(words[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)
