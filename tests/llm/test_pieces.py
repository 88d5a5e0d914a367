"""Parts are encoded at once, in any order, with the library's ids."""

import random

import public_tokenizers
import pyarrow as pa

from abridge.llm import textkit
from abridge.llm.pieces import BytePieces

JSON = public_tokenizers.path("byte_bpe_50k.json")


def _ids(known, texts):
    """Ids of each text."""
    for which, ids, start, size, first in known.ragged(textkit.as_text(pa.array(texts, pa.string()))):
        for a, b in zip(first, first[1:]):
            yield [int(x) for k in which[a:b] for x in ids[start[k] : start[k] + size[k]]]


class _Counted:
    def __init__(self, fast):
        self.fast, self.calls = fast, 0

    def __getattr__(self, name):
        def call(*args, **options):
            self.calls += 1
            return getattr(self.fast, name)(*args, **options)

        return call


def test_distinct_parts_are_encoded_at_once():
    """One call for each word took op3_packing over its CPU seconds."""
    known = BytePieces(JSON)
    known.fast = _Counted(known.fast)
    rng = random.Random(7)
    texts = ["Start " + " ".join("".join(rng.choices("aeioulmnrst", k=9)) for _ in range(500)) for _ in range(10)]
    list(known.ragged(pa.array(texts, pa.large_string())))
    assert known.fast.calls <= 2  # the parts, and the texts' first part


def test_runs_of_blanks_without_end():
    known = BytePieces(JSON)
    texts = ["x" + "\n" * 1_200_000 + "y z", "a b", "q x" + "\t" * 1_200_000 + "y z"]
    for k, got in enumerate(_ids(known, texts)):
        assert got == known.whole.encode(texts[k], add_special_tokens=False).ids


def test_ids_are_the_librarys_in_any_order():
    known, rng = BytePieces(JSON), random.Random(3)
    pools = [[chr(c) for c in range(0x250)], list("ab 12'.,\n\t  éß"), list(" \n\t\x1c\x1d\x85\xa0ab"), list("aɏɐ日 　​ x,")]
    bits = ["<|endoftext|>", "'s", " don't", "  ", "\r\n", "the", " and"]
    for r in range(80):
        texts = ["".join(rng.choice(bits if rng.random() < 0.1 else pools[r % 4] if rng.random() < 0.85 else " ") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 40))] + [None]
        for text, got in zip(texts, _ids(known, texts), strict=True):
            assert got == known.whole.encode(text or "", add_special_tokens=False).ids, text
    assert list(_ids(known, [""])) == [[]]
    known.fast = None  # no ranks beside the file
    assert list(_ids(known, ["a b  c", "日 <|endoftext|>"])) == [known.whole.encode(t, add_special_tokens=False).ids for t in ("a b  c", "日 <|endoftext|>")]
