"""URL rules as globs, run by one bit-parallel automaton over each canonical URL.

A canonical URL is host + path. In a glob `*` stands for any run without `/`, `**` for any run, `?` for
one byte but `/`; all else stands for itself. Every glob owns a start bit and a bit for each byte it
consumes, packed into as many 64-bit words as all globs need together. One step over a byte c is
    D = (D << 1) & B[c] | D & S[c]
where B has the bits that c may enter and S those it may stay in (stars); the shift carries from word to
word. All URLs of a batch step together, all globs in each step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abridge.llm import textkit


@dataclass(frozen=True)
class Rule:
    """A host and path that stands for the host, its subdomains, and all paths that begin so."""

    name: str
    verdict: str

    def globs(self) -> list[str]:
        return [f"{self.name}**", f"*.{self.name}**"]


RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))
#: Globs that block where no rule speaks: hosts that name spam, and shops of pills or casinos.
BLOCKED = ("spam-*/**", "*.spam-*/**", "*cheap-pills*/**", "*casino*/**", "**/wp-login.php**")


def _parsed(glob: str) -> tuple[list[np.ndarray], dict[int, np.ndarray]]:
    """The byte class of each consuming place; stars as byte classes after so many places."""
    everything = np.ones(256, bool)
    in_part = everything.copy()
    in_part[ord("/")] = False
    places, stars, data, k = [], {}, glob.encode(), 0
    while k < len(data):
        c = data[k : k + 1]
        if c == b"*":
            wide = data[k + 1 : k + 2] == b"*"
            stars[len(places)] = stars.get(len(places), ~everything) | (everything if wide else in_part)
            k += 1 + wide
            continue
        one = in_part if c == b"?" else np.arange(256) == c[0]
        places.append(one)
        k += 1
    return places, stars


class Automaton:
    """matches(urls) -> boolean matrix, a row for each URL and a column for each glob."""

    def __init__(self, globs: list[str]):
        parsed = [_parsed(g) for g in globs]
        bits = sum(len(p) + 1 for p, _ in parsed)
        self.words = max(1, -(-bits // 64))
        enter, stay = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        self.start, self.ends = np.zeros(self.words, np.uint64), []
        bit = 0
        for places, stars in parsed:
            one = lambda k: (k // 64, np.uint64(1) << np.uint64(k % 64))
            word, mask = one(bit)
            self.start[word] |= mask
            for k, where in enumerate(places):
                word, mask = one(bit + k + 1)
                enter[where, word] |= mask
            for k, where in stars.items():
                word, mask = one(bit + k)
                stay[where, word] |= mask
            bit += len(places) + 1
            self.ends.append(bit - 1)
        self.enter, self.stay = enter, stay

    def matches(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        size = np.diff(at)
        order = np.argsort(-size, kind="stable")
        begin, size = at[:-1][order], size[order]
        state = np.tile(self.start, (len(order), 1))
        live = len(order)
        for k in range(int(size[0]) if len(size) else 0):
            while live and size[live - 1] <= k:
                live -= 1
            c, now = data[begin[:live] + k], state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = moved & self.enter[c] | now & self.stay[c]
        out = np.zeros((len(order), len(self.ends)), bool)
        for j, bit in enumerate(self.ends):
            out[order, j] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
        return out


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, blocked: tuple[str, ...] = BLOCKED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of each row; other columns are not read.

    The longest rule that fits decides; without one, `block` if a glob of `blocked` fits the canonical URL,
    else `allow`; of rules of one length the first by name. A null url, or one without `://`, has empty host and path and is allowed. Rows that
    repeat are judged each; an empty table gives no rows. URLs are read whole: a batch takes as many steps as its longest one has bytes.
    """
    rules = tuple(sorted(rules, key=lambda r: (-len(r.name), r.name)))
    globs = [g for r in rules for g in r.globs()] + list(blocked)
    rest = F.expr(f"if(instr(`{url_col}`, '://') > 0, substr(`{url_col}`, instr(`{url_col}`, '://') + 3), '')")
    parts = (
        pages.select(F.col(id_col), F.coalesce(rest, F.lit("")).alias("rest"))
        .withColumn("raw", F.regexp_extract("rest", "^[^/?#]*", 0))
        .withColumn("path", F.regexp_extract(F.expr("substr(rest, length(raw) + 1)"), "^[^?#]*", 0))
        .select(id_col, F.translate("raw", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), "path")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(globs)
        for batch in batches:
            both = pc.binary_join_element_wise(textkit.as_text(batch.column(1)), textkit.as_text(batch.column(2)), pa.scalar("", pa.large_string()))
            hit = machine.matches(*textkit.raw(both))
            ruled = hit[:, : 2 * len(rules)].reshape(len(both), len(rules), 2).any(axis=2)
            which = np.where(ruled.any(axis=1), ruled.argmax(axis=1), len(rules)) if rules else np.zeros(len(both), int)
            other = np.where(hit[:, 2 * len(rules) :].any(axis=1), "block", "allow")
            names, verdicts = [*[r.name for r in rules], None], [*[r.verdict for r in rules], None]
            rule = [names[k] for k in which]
            verdict = [verdicts[k] or o for k, o in zip(which, other)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array([str(v) for v in verdict], pa.string())], [id_col, "host", "path", "rule", "verdict"])

    kind = dict(parts.dtypes)[id_col]
    return parts.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
