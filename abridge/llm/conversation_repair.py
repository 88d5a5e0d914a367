"""Repair of conversations to `(s?(ua)+)?` by the cheapest edits.

The turns that stay are a subsequence: each is kept or given another role, the turns between two of them go. What it
costs that turns go is a prefix sum (every turn costs DELETE), so of all ways to end in a state only the least of
(cost - sum) has to be known: one running minimum for each state of the output, which are nothing yet, the system
turn, a user turn, an assistant turn. The roles of two neighbours that stay say what has to be inserted between them.
Of edits of one cost those win whose initials, in order, are least in ASCII. Two ways that have read the same turns
never begin with each other, so an order among the states' best ways, carried from turn to turn, decides that
without comparing strings.

Turns come sorted by conversation, and are read once: each state carries the SHA-256 of what it would put out, so no
text is held. Of a conversation a task remembers two bytes a turn and state for the audit and a digest for each
different turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from abridge.llm.common import small_batches

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the output: what it ends with.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {"su", "ua", "au"}
#: Inserts between a state and the role of the next turn that stays, and the end.
TO_USER = {NOTHING: 0, SYSTEM: 0, USER: 1, ASSISTANT: 0}
TO_ASSISTANT = {NOTHING: 1, SYSTEM: 1, USER: 0, ASSISTANT: 1}
TO_END = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: What is inserted after a state, one turn or two.
INSERTED = {NOTHING: ("user",), SYSTEM: ("user", "assistant"), USER: ("assistant",), ASSISTANT: ("user",)}


def _moves() -> dict[str, list[tuple[int, int, int, str, str | None]]]:
    """For each role initial, and others: (state before, state after, cost, edits, new role) of a turn that stays."""
    out = {}
    for initial in ("s", "u", "a", ""):
        ways = [(p, t, REROLE + INSERT * n[p], "I" * n[p] + "R", role) for t, n, role in ((USER, TO_USER, "user"), (ASSISTANT, TO_ASSISTANT, "assistant")) for p in range(4)]
        if initial == "s":
            ways.append((NOTHING, SYSTEM, 0, "K", None))
        elif initial:
            t, n = (USER, TO_USER) if initial == "u" else (ASSISTANT, TO_ASSISTANT)
            ways += [(p, t, INSERT * n[p], "I" * n[p] + "K", None) for p in range(4)]
        out[initial] = ways
    return out


MOVES = _moves()
#: Edits of one step, as numbers in the trail.
STEPS = ("D", "K", "R", "IK", "IR")


class Conversation:
    """Turns of one conversation, as they come."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.rows = self.distinct = 0
        self.low = self.high = self.turn = None
        self.before = ""
        self.seen: set[bytes] = set()
        self.gone = 0  # what it costs that all turns so far go
        self.best: list[int | None] = [0, None, None, None]  # cost less `gone`
        self.rank = [0, 0, 0, 0]
        self.text = [hashlib.sha256(), None, None, None]
        self.any = [False] * 4  # anything put out
        self.trail = bytearray()  # for each turn and state: state before, and step

    def add(self, turn: int | None, role: str, text: str, blank: bool, truncated: bool) -> None:
        """The next turn, in order."""
        self.rows += 1
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.distinct += turn != self.turn
            self.turn = turn
        initial = role[:1]
        self.illegal += self.rows > 1 and self.before + initial not in LEGAL
        self.before = initial
        said = f"{role}:{text}"
        mark = hashlib.blake2b(f"{len(role)}:{said}".encode(), digest_size=16).digest()
        twice = mark in self.seen
        self.seen.add(mark)
        if blank:
            self.blank += 1
        elif twice:
            self.duplicate += 1
        elif truncated:
            self.truncated += 1
        best, rank = self.best, self.rank
        # a state's best way goes on without this turn
        new = [None if c is None else (c, rank[s], "D", s, None) for s, c in enumerate(best)]
        if not (blank or twice):
            extra = TRUNCATED * truncated - DELETE
            for p, t, cost, edits, to in MOVES.get(initial, MOVES[""]):
                if best[p] is not None:
                    way = (best[p] + cost + extra, rank[p], edits, p, to)
                    if new[t] is None or way[:3] < new[t][:3]:
                        new[t] = way
        self.gone += DELETE
        order = sorted((w[1], w[2], s) for s, w in enumerate(new) if w)
        for k, (_, _, s) in enumerate(order):
            rank[s] = k
        texts, anys = list(self.text), list(self.any)
        for s, w in enumerate(new):
            self.trail.append((w[3] << 3) | STEPS.index(w[2]) if w else 0)
            if not w or w[2] == "D":
                continue
            best[s] = w[0]
            h, written = texts[w[3]].copy(), anys[w[3]]
            for r in INSERTED[w[3]][: len(w[2]) - 1]:
                h.update(f"\n{r}:".encode() if written else f"{r}:".encode())
                written = True
            h.update((("\n" if written else "") + (f"{w[4]}:{text}" if w[4] else said)).encode())
            self.text[s], self.any[s] = h, True

    def result(self) -> tuple:
        """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of all turns."""
        cost, _, s = min((c + INSERT * TO_END[s], self.rank[s], s) for s, c in enumerate(self.best) if c is not None)
        h, written = self.text[s], self.any[s]
        for r in INSERTED[s][: TO_END[s]]:
            h.update(f"\n{r}:".encode() if written else f"{r}:".encode())
            written = True
        edits = ["I" * TO_END[s]]
        for k in range(self.rows - 1, -1, -1):
            code = self.trail[4 * k + s]
            edits.append(STEPS[code & 7])
            s = code >> 3
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost + self.gone, "".join(reversed(edits)), h.hexdigest()


def _flagged(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, alive_col: str | None) -> DataFrame:
    """Turns with what Spark can tell of each: no letter or sign at all, no full stop at the end. A null role or text reads as one blank."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    alive: Column = F.coalesce(F.col(alive_col), F.lit(False)) if alive_col else F.lit(True)
    return rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), F.when(alive, text).otherwise("").alias("text"), alive.alias("alive"),
        (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
    )


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", alive_col: str | None = None) -> DataFrame:
    """One row for each conversation: (conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    Turns are read by number, nulls first, equal numbers by role and text. A turn's first fault counts: blank (no sign but ASCII
    blanks), duplicate (role and text seen earlier), truncated (last sign not one of . ! ?). Edits: K keeps a turn, R
    gives it the role user or assistant (3), D deletes it (4; a must for blank and duplicate turns), I inserts an empty user or
    assistant turn (3); truncated turns that stay add 3. `audit` has the initials of the cheapest edits that lead to roles
    of the form (s?(ua)+)?, of equal ones the least in ASCII. `gaps` are numbers missing between the least and the greatest.
    Rows whose `alive_col` is not true only name their conversation; one without others has zeros, an empty audit
    and the digest of nothing. A null conversation is one of its own. An empty table gives no rows. Repeated rows are duplicates.
    A conversation's digest is that of one text, so one task reads it, turn by turn, without holding its texts.
    """
    small_batches(rows.sparkSession)
    flagged = _flagged(rows, conv_col, turn_col, role_col, text_col, alive_col)
    kind = dict(flagged.dtypes)["conv"]
    dealt = flagged.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    shape = pa.schema([("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type, done, state, now = None, [], None, None

        def told() -> pa.RecordBatch:
            columns = list(zip(*(r for _, r in done)))
            out = pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], conv_type), *(pa.array(v, f.type) for v, f in zip(columns, shape))], ["conv", *shape.names])
            done.clear()
            return out

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for conv, turn, role, text, alive, blank, cut in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != now:
                    if state:
                        done.append((now, state.result()))
                    state, now = Conversation(), conv
                if alive:
                    state.add(turn, role, text, blank, cut)
            if len(done) >= 1000:
                yield told()
        if state:
            done.append((now, state.result()))
        if done:
            yield told()

    made = dealt.mapInArrow(repair, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return made.withColumnRenamed("conv", conv_col)


def repaired_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, place, edit, turn, role, text): the turns of repaired conversations, place from 1; inserted ones have a null turn.

    Edits are those of `repair_conversations`; a conversation's texts are joined to its edits, never gathered.
    """
    audits = repair_conversations(rows, conv_col, turn_col, role_col, text_col).where("audit <> ''").select(F.col(conv_col).alias("conv"), "audit")
    edits = audits.select("conv", F.posexplode(F.split("audit", "")).alias("at", "edit"))
    in_order = W.partitionBy("conv").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    staying = F.col("edit") != "D"
    edits = edits.select("conv", "at", "edit", F.sum((F.col("edit") != "I").cast("long")).over(in_order).alias("k"), F.sum(staying.cast("long")).over(in_order).alias("place"))
    turns = _flagged(rows, conv_col, turn_col, role_col, text_col, None)
    numbered = turns.withColumn("k", F.row_number().over(W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long")).select(F.struct("conv").alias("c"), "k", "turn", "role", "text")
    joined = edits.where(staying).withColumn("c", F.struct("conv")).join(numbered, ["c", "k"], "left")
    own = F.col("edit") != "I"
    system = joined.where("place = 1 AND edit = 'K' AND role LIKE 's%'").select("c", F.lit(1).alias("lead"))
    odd = (F.col("place") - F.coalesce("lead", F.lit(0))) % 2 == 1
    role = F.when(F.col("edit") == "K", F.col("role")).when(odd, "user").otherwise("assistant")
    return joined.join(system, "c", "left").select(F.col("conv").alias(conv_col), "place", "edit", F.when(own, F.col("turn")).alias("turn"), role.alias("role"), F.when(own, F.col("text")).otherwise("").alias("text"))
