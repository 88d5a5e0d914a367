import random

import pytest
from pyspark.sql import functions as F

from abridge.llm.group_ranking import rank_in_groups

SHAPE = "g string, h long, big long, small double, t long, u string, `__n` string, pos string"


def _brute(rows, places):
    last = lambda v, down=False: (v is None, 0 if v is None else -v if down else v)
    text = lambda v: (v is None, v or "")
    groups: dict = {}
    for r in rows:
        groups.setdefault((r[0], r[1]), []).append(r)
    out = []
    for members in groups.values():
        members.sort(key=lambda r: (last(r[2], True), last(r[3]), last(r[4]), text(r[5])))
        for pos, r in enumerate(members[:places], 1):
            out.append((*r[:6], pos, sum(m[2:4] == r[2:4] for m in members)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("places, tasks, batch", [(1, 5, 3), (2, 9, 1), (3, 7, 10000), (40, 6, 4)])
def test_ranks_against_brute_force(spark, places, tasks, batch):
    rng = random.Random(places)
    rows = []
    for k in range(700):  # half of all rows are one group, a third of those one pair, and rows repeat
        hot = k % 2
        rows.append((
            "hot" if hot else rng.choice(["a", "b", None, "c" * 300]), 1 if hot else rng.choice([1, 2, None]),
            3 if hot and k % 3 == 0 else rng.choice([1, 2, 3, None]), 0.5 if hot and k % 3 == 0 else rng.choice([0.5, 0.25, None]),
            rng.choice([1, 2, None]), rng.choice(["x", "y", None, ""]), "n", "p",
        ))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = rank_in_groups(spark.createDataFrame(rows, SHAPE).repartition(5), ["g", "h"], [("big", True), ("small", False)], ["t", "u"], places, tasks=tasks).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert sorted(repr(tuple(r)) for r in got) == _brute(rows, places)


def test_one_row_repeated_spans_all_tasks(spark):
    rows = spark.range(4000).select(F.lit("g").alias("g"), F.lit(1).alias("p"), F.lit(None).cast("long").alias("t"))
    got = rank_in_groups(rows, ["g"], [("p", True)], ["t"], 3, tasks=16).orderBy("pos").collect()
    assert [(r.pos, r.tied) for r in got] == [(1, 4000), (2, 4000), (3, 4000)]


def test_pairs_that_begin_in_one_task_and_end_in_another(spark):
    rows = spark.range(3000).selectExpr("'g' AS g", "id div 2 AS p", "id AS t")
    got = rank_in_groups(rows, ["g"], [("p", False)], ["t"], 2999, tasks=12).collect()
    assert len(got) == 2999 and {r.tied for r in got} == {2} and sorted(r.pos for r in got) == [r + 1 for r in range(2999)]


def test_empty_table_and_places(spark):
    empty = spark.createDataFrame([], "g string, p long, t long")
    assert rank_in_groups(empty, ["g"], [("p", True)], ["t"], 2).collect() == []
    with pytest.raises(ValueError):
        rank_in_groups(empty, ["g"], [("p", True)], ["t"], 0)


def test_nan_is_one_value_and_kept_columns_travel(spark):
    rows = spark.createDataFrame([("g", float("nan"), 1, "a"), ("g", float("nan"), 2, "b"), ("g", 1.0, 3, "c")], "g string, p double, t long, more string")
    got = rank_in_groups(rows, ["g"], [("p", True)], ["t"], 3, keep=["more"], tasks=1).orderBy("pos").collect()
    assert [(r.more, r.pos, r.tied) for r in got] == [("a", 1, 2), ("b", 2, 2), ("c", 3, 1)]
