import hashlib
import random
import re
from functools import lru_cache

from abridge.llm.conversation_repair import repair_conversations, repaired_turns
from abridge.llm.conversation_repair_query import damaged

BLANK = " \t\n\x0b\x0c\r"


def _plain(turns):
    """Cheapest edits from the end of the conversation, with whole strings; inserts and deletions in any order."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    seen, faults, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in turns:
        bare = text.strip(BLANK)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        if fault:
            counts[fault] += 1
    after = {"": {"s": "s", "u": "u", "a": None}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(i, state, inserts):
        ways = [(0, "", ())] if i == len(turns) and state in ("", "a") else []
        for initial, role in (("u", "user"), ("a", "assistant")):
            if inserts < 3 and after[state].get(initial):
                cost, audit, out = best(i, initial, inserts + 1)
                ways.append((cost + 3, "I" + audit, (f"{role}:", *out)))
        if i < len(turns):
            _, role, text = turns[i]
            cost, audit, out = best(i + 1, state, inserts)
            ways.append((cost + 4, "D" + audit, out))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                for edit, own, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if own[:1] and after[state].get(own[:1]):
                        cost, audit, out = best(i + 1, own[:1], 0)
                        ways.append((cost + price + extra, edit + audit, (f"{own}:{text}", *out)))
        return min(ways, key=lambda w: w[:2]) if ways else (10**9, "", ())

    cost, audit, out = best(0, "", 0)
    numbers = {t[0] for t in turns} - {None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), out


def _conversations(n, seed):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for k in range(rng.randrange(0, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            out.append((c, rng.choice([k, k, k, k + 2, None]), role, rng.choice(["Yes.", "No! \n", "go on", "", " \t", None, "Why?", "é…", f"number {k}."])))
    return out


def test_repairs_against_brute_force(spark):
    rows = _conversations(260, 5)
    got = {r.conv_id: tuple(r)[1:] for r in repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)).collect()}
    want: dict = {}
    for c, turn, role, text in rows:
        want.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got == {c: _plain(t)[0] for c, t in want.items()}
    assert all(re.fullmatch("[KRDI]*", r[6]) for r in got.values()) and sum(r[5] > 0 for r in got.values()) > 100


def test_repaired_turns_are_what_was_digested(spark):
    rows = _conversations(80, 6) + [(None, 1, "user", "null."), (None, 2, "assistant", "fine.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    said: dict = {}
    for r in repaired_turns(df).orderBy("place").collect():
        said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in repair_conversations(df).collect():
        assert hashlib.sha256("\n".join(said.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_one_long_conversation(spark):
    n = 30_000
    df = spark.range(n).selectExpr("7 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "if(id = 11, 'cut', concat('turn ', id, '.')) AS text")
    (r,) = repair_conversations(df).collect()
    assert (r.gaps, r.truncated, r.cost, r.audit) == (0, 1, 3, "K" * n)
    text = "\n".join(f"{'user' if k % 2 == 0 else 'assistant'}:{'cut' if k == 11 else f'turn {k}.'}" for k in range(n))
    assert r.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_damage_names_every_conversation(spark):
    nothing = hashlib.sha256(b"").hexdigest()
    rows = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", "So.") for c in range(60) for t in range(2)] + [(None, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in repair_conversations(damaged(rows), alive_col="alive").collect()}
    assert set(got) == {None, *range(60)}
    empty = {r.conv_id for r in damaged(rows).groupBy("conv_id").agg({"alive": "max"}).where("not `max(alive)`").collect()}
    assert all((got[c].cost, got[c].audit, got[c].repaired_sha256) == (0, "", nothing) for c in empty)


def test_empty_table_clashing_columns_and_own_names(spark):
    shape = "id string, n int, role string, body string, alive int, blank int, cut int, conv int"
    assert repair_conversations(spark.createDataFrame([], shape), "id", "n", "role", "body").collect() == []
    df = spark.createDataFrame([("x", 0, "user", "Hi.", 1, 2, 3, 4)], shape)
    (r,) = repair_conversations(df, "id", "n", "role", "body").collect()
    assert (r.id, r.cost, r.audit) == ("x", 3, "KI")
