"""Byte-level BPE through distinct pre-tokens: those of a slice are encoded at once, texts are looked up.

A text is cut before every single space that stands before something not blank. The pre-tokeniser's pattern always
begins a pre-token there, so a text's tokens are those of its parts in turn, and parts may stand in any order. Parts of a
slice are made distinct by Arrow's dictionary encoding and strung together as one text; what its tokens
spell shows where each part's begin.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from contextlib import suppress
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from abridge.llm import textkit
from abridge.llm.common import worker_cache

#: Parts encoded one by one that a worker remembers at most; beyond, it starts anew. About 250 bytes each.
REMEMBERED = 250_000
#: Bytes of a part beyond which it is encoded by itself.
LONG = 1 << 14
_CUT = re.compile(r"(?= \S)")


class BytePieces:
    """Token ids of parts under a tokenizers .json file, and its vocabulary as ranks where there is one beside it."""

    def __init__(self, json_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.fast = None
        ranks = json_path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks) as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(str.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
            self.spelt = np.zeros(max(merges.values()) + 1, np.int64)
            self.spelt[list(merges.values())] = [len(m) for m in merges]
        specials = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        #: What ranks do not serve, for Python and Arrow: all but Latin script, and special strings.
        self.other = "|".join(["[\u0250-\U0010ffff]", *specials])
        self.parts: dict[str, tuple[int, ...]] = {}

    def encode(self, part: str) -> tuple[int, ...]:
        """Ids of one part. Ranks serve what is Latin script without special strings; the file's own library the rest."""
        found = self.parts.get(part)
        if found is None:
            if self.fast and not re.search(self.other, part):
                with suppress(ValueError):  # blanks without end are more than its search goes back over
                    found = tuple(self.fast.encode_to_numpy(part, disallowed_special=()).tolist())
            if found is None:
                found = tuple(self.whole.encode(part, add_special_tokens=False).ids)
            if len(part) <= 64:
                if len(self.parts) >= REMEMBERED:
                    self.parts.clear()
                self.parts[part] = found
        return found

    def ragged(self, text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For ranges of rows of `text`: part numbers in order, ids of all parts, where in them each part's begin, how many each part has, first part of each text (one more at the end)."""
        for a, b in textkit.slices(text, 6 << 20):
            yield self._ragged(text.slice(a, b - a))

    def _each(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, one part at a time, and how many each has."""
        ids = [self.encode(p) for p in parts]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size

    def _at_once(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that each have a space before them and begin with something not blank, and how many each has."""
        if not len(parts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        line = pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts)
        ids = self.fast.encode_to_numpy(" " + pc.binary_join(line, pa.scalar(" ", pa.large_string()))[0].as_py(), disallowed_special=())
        ends = np.cumsum(pc.binary_length(parts).to_numpy().astype(np.int64) + 1)
        return ids, np.diff(np.searchsorted(np.cumsum(self.spelt[ids]), ends) + 1, prepend=0)

    def _ragged(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lists = pc.split_pattern(text, " ")
        first = lists.offsets.to_numpy()
        first = first - first[0]
        coded = lists.flatten().dictionary_encode()
        which, parts = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        blank = pc.or_(pc.equal(parts, ""), pc.utf8_is_space(pc.utf8_slice_codeunits(parts, 0, 1))).to_numpy(zero_copy_only=False)
        odd = blank[which]
        odd[first[:-1]] = False
        tails: dict[str, int] = {}
        heads = parts.take(pa.array(which[first[:-1]])).to_pylist()
        if odd.any():  # runs of blanks: cut those texts one by one
            runs, many, done = [], np.diff(first), 0
            for i in np.unique(np.searchsorted(first, np.flatnonzero(odd), "right") - 1).tolist():
                heads[i], *rest = _CUT.split(text[i].as_py())
                runs += [which[done : first[i] + 1], np.array([tails.setdefault(p[1:], len(parts) + len(tails)) for p in rest], np.int64)]
                many[i], done = 1 + len(rest), first[i + 1]
            which, first = np.concatenate([*runs, which[done:]]), np.append(0, np.cumsum(many))
            parts, blank = pa.concat_arrays([parts, pa.array(list(tails), parts.type)]), np.append(blank, np.zeros(len(tails), bool))
        # The first part of a text has no space before it.
        number = {head: len(parts) + k for k, head in enumerate(dict.fromkeys(heads))}
        which[first[:-1]] = [number[head] for head in heads]
        single = pc.or_(pc.match_substring_regex(parts, self.other), pc.greater(pc.binary_length(parts), LONG if self.fast else -1)).to_numpy(zero_copy_only=False)
        order = [np.flatnonzero(~single & ~blank), np.flatnonzero(single & ~blank), np.arange(len(parts), len(parts) + len(number))]
        plain, alone = (parts.take(pa.array(k)) for k in order[:2])
        made = [self._at_once(plain), self._each([" " + p for p in alone.to_pylist()]), self._each(list(number))]
        ids, many = (np.concatenate(v) for v in zip(*made))
        start, size = np.zeros((2, len(parts) + len(number)), np.int64)
        order = np.concatenate(order)
        start[order], size[order] = np.cumsum(many) - many, many
        return which, ids, start, size, first


def pieces(json_path: str) -> BytePieces:
    """One for each worker and file; workers are used again, and so is what they remember."""
    known = worker_cache("pieces")
    if json_path not in known:
        known.clear()
        known[json_path] = BytePieces(json_path)
    return known[json_path]
