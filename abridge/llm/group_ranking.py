"""Ranks within groups by a secondary sort, with ties counted, over any skew.

Rows are dealt to tasks by ranges of (group, pair, order) and sorted inside each task: the partitioner cuts a large
group at its pairs, a large pair at the order below it, and equal rows by their place in the input, so no task gets
more than its share whatever group, pair or row is frequent. A state machine streams over each task's sorted rows and
holds a handful of them. Groups that begin and end inside a task are done then. For the first and the last group of a
task, which may go on in its neighbours, a summary of one row is left; a second pass adds up summaries in order of
tasks and repairs places and counts of ties.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from abridge.llm.common import small_batches, stored


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before; nulls are equal, NaN too."""
    a, b = column[1:], column[:-1]
    out = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    if column.null_count:
        out = out | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    if pa.types.is_floating(column.type):
        out = out & ~(pc.fill_null(pc.is_nan(a), False).to_numpy(zero_copy_only=False) & pc.fill_null(pc.is_nan(b), False).to_numpy(zero_copy_only=False))
    return np.concatenate([[True], out])


class RankStream:
    """What is known of a task's rows so far: finished groups are handed out, of the unfinished one some rows remain.

    A remaining row stands for `weight` rows. Kept are the lines of the first places, and for the group's first and
    last pair, and those of kept lines, one more row that stands for their rest; one row stands for all pairs between.
    """

    def __init__(self, group: Sequence[str], pair: Sequence[str], lines: Sequence[str], places: int):
        self.group, self.pair, self.lines, self.places = list(group), list(pair), list(lines), places
        self.rest: tuple[pa.Table, np.ndarray, np.ndarray] | None = None
        self.begun = False

    def feed(self, batch: pa.RecordBatch) -> pa.Table | None:
        """Take sorted rows; the groups that ended with them."""
        if not batch.num_rows:
            return None
        rows, weight, real = pa.Table.from_batches([batch]), np.ones(batch.num_rows, np.int64), np.ones(batch.num_rows, bool)
        if self.rest:
            rows = pa.concat_tables([self.rest[0], rows])
            weight, real = np.concatenate([self.rest[1], weight]), np.concatenate([self.rest[2], real])
        return self._step(rows.combine_chunks(), weight, real, last=False)

    def end(self) -> pa.Table | None:
        """The last group."""
        return self._step(*self.rest, last=True) if self.rest else None

    def _step(self, rows: pa.Table, weight: np.ndarray, real: np.ndarray, last: bool) -> pa.Table | None:
        flags = lambda names: np.logical_or.reduce([_changes(rows.column(c).chunk(0)) for c in names]) if names else np.arange(len(weight)) == 0
        new_group = flags(self.group)
        new_run = new_group | flags(self.pair)
        gid, rid = np.cumsum(new_group) - 1, np.cumsum(new_run) - 1
        starts, runs = np.flatnonzero(new_group), np.flatnonzero(new_run)
        total = np.cumsum(weight)
        pos = total - (total[starts] - weight[starts])[gid]
        size, run = np.add.reduceat(weight, starts), np.add.reduceat(weight, runs)
        held = real & (pos <= self.places)
        done = len(starts) - (not last)
        out = None
        if done:
            out = self._groups(rows, gid, rid, starts, size, run, pos, held, done, last)
            self.begun = True
        self.rest = None if last else self._compressed(rows, weight, rid, int(starts[-1]), run, held)
        return out

    def _groups(self, rows, gid, rid, starts, size, run, pos, held, done, last) -> pa.Table:
        edge = np.zeros(done, bool)
        edge[0] |= not self.begun
        edge[-1] |= last
        at = np.flatnonzero(held & (gid < done))
        names = [*self.pair, *self.lines]
        items = pa.StructArray.from_arrays(
            [*(rows.column(c).chunk(0).take(pa.array(at)) for c in names), pa.array(pos[at]), pa.array(run[rid[at]])], names=[*names, "__pos", "__tied"]
        )
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(gid[at], np.arange(done + 1)), pa.int32()), items)
        # the first and the last pair of an edge group, once if it is one
        ends = np.append(starts[1:], len(gid))[:done] - 1
        two = rid[ends] != rid[starts[:done]]
        picked = np.stack([starts[:done], ends], 1)[np.stack([edge, edge & two], 1)]
        offsets = np.concatenate([[0], np.cumsum(edge.astype(np.int64) + (edge & two))])
        pairs = pa.StructArray.from_arrays([*(rows.column(c).chunk(0).take(pa.array(picked)) for c in self.pair), pa.array(run[rid[picked]])], names=[*self.pair, "__run"])
        first = pa.array(starts[:done])
        return pa.table(
            [*(rows.column(c).chunk(0).take(first) for c in self.group), pa.array(edge), pa.array(size[:done]), lists, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)],
            names=[*self.group, "__edge", "__n", "__lines", "__runs"],
        )

    def _compressed(self, rows, weight, rid, begin, run, held):
        r = rid[begin:]
        keep = held[begin:]
        kept_of = np.bincount(r - r[0], keep, minlength=int(r[-1] - r[0]) + 1).astype(np.int64)
        left = run[r[0] :] - kept_of  # rows of each run that are not lines of a place
        named = kept_of > 0
        named[[0, -1]] = True
        at, weights, is_real = [], [], []
        firsts = np.searchsorted(r, np.arange(r[0], r[-1] + 1))
        between = np.flatnonzero(~named)
        for k in np.flatnonzero(named):
            if len(between) and k == len(named) - 1:
                at.append(firsts[between[-1]]), weights.append(int(left[between].sum())), is_real.append(False)
            lines = np.flatnonzero(keep & (r == r[0] + k)) if kept_of[k] else ()
            at.extend(lines), weights.extend([1] * len(lines)), is_real.extend([True] * len(lines))
            if left[k]:
                at.append(firsts[k]), weights.append(int(left[k])), is_real.append(False)
        return rows.take(pa.array(np.array(at) + begin)).combine_chunks(), np.array(weights, np.int64), np.array(is_real)


def rank_in_groups(rows: DataFrame, group: Sequence[str], pair: Sequence[tuple[str, bool]], then: Sequence[str], places: int, keep: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """(*group, *pair, *then, *keep, pos, tied) of the lines whose place in their group is at most `places`.

    Within a group lines follow each other by `pair` (name, whether larger comes first), then by the columns `then`,
    ascending; nulls come last and equal each other. `pos` counts from 1 and tells equal lines apart; `tied` counts the
    group's lines of the same pair, whatever their places. A null group is a group. Rows that repeat are ranked each; an empty table
    gives no rows. Values of any length and type that Spark orders will do; other columns of `rows` are left alone,
    whatever their names. A task keeps a few lines of one group; what it tells of a group that may go on in other tasks
    is one row.
    """
    if places < 1:
        raise ValueError("places begin with 1")
    spark = rows.sparkSession
    small_batches(spark)
    pairs, lines = [c for c, _ in pair], [*then, *keep]
    wanted = rows.select(*group, *pairs, *lines)
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order: list[Column] = [*(F.col(c).asc_nulls_first() for c in group), *(F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in pair), *(F.col(c).asc_nulls_last() for c in then)]
    # equal lines may be cut anywhere: their place in the input tells them apart
    dealt = wanted.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(n, *order, "__at").sortWithinPartitions(*order).drop("__at")
    kinds = {f.name: StructField(f.name, f.dataType) for f in wanted.schema}
    long = lambda name: StructField(name, LongType())
    shape = StructType([*(kinds[c] for c in group)]).add("__edge", "boolean").add(long("__n"))
    shape = shape.add("__lines", ArrayType(StructType([*(kinds[c] for c in (*pairs, *lines)), long("__pos"), long("__tied")])))
    shape = shape.add("__runs", ArrayType(StructType([*(kinds[c] for c in pairs), long("__run")]))).add("__task", "integer")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, task = RankStream(group, pairs, lines, places), TaskContext.get().partitionId()
        told = lambda t: t.append_column("__task", pa.array(np.full(t.num_rows, task, np.int32))).combine_chunks().to_batches()
        for batch in batches:
            if (out := state.feed(batch)) is not None:
                yield from told(out)
        if (out := state.end()) is not None:
            yield from told(out)

    found = stored(dealt.mapInArrow(stream, shape), "ranked")
    columns = [*group, *pairs, *lines]
    done = found.where("not __edge").select(*group, F.inline("__lines")).select(*columns, F.col("__pos").alias("pos"), F.col("__tied").alias("tied"))

    in_tasks = W.partitionBy(*group).orderBy("__task").rowsBetween(W.unboundedPreceding, -1)
    edges = found.where("__edge")
    moved = edges.withColumn("__before", F.coalesce(F.sum("__n").over(in_tasks), F.lit(0))).where(F.col("__before") < places)
    moved = moved.select(*group, "__before", F.inline("__lines")).withColumn("__pos", F.expr("__pos + __before")).where(F.col("__pos") <= places)
    both = F.struct(*(F.col(c) for c in (*group, *pairs)))  # structs are equal where the same members are null
    runs = edges.select(*group, F.inline("__runs")).groupBy(both.alias("__of")).agg(F.sum("__run").alias("__all"))
    moved = moved.withColumn("__of", both).join(runs, "__of", "left").select(*columns, F.col("__pos").alias("pos"), F.coalesce("__all", "__tied").alias("tied"))
    return done.unionByName(moved)
