"""Sets whose documents arrive over several micro-batches: gathered in keyed state, closed by event time, then summarised.

A set is closed when the stream has gone on for `delay` beyond the set's last document and a silence of `gap`. Documents of a
closed set that come after that, up to `grace` later, are handed out as late ones; a later document than that begins the set anew if the
silence was long enough, and is dropped by the watermark, and counted there, if it is older than all that. State holds open sets and the marks of
those closed within `grace`; it is partitioned by set and lives in the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from abridge.api import summarize
from abridge.config import Config
from abridge.sources.lists import Lists

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Gather(StatefulProcessor):
    """Documents (at, pos, text) of a set until it is closed; times in milliseconds."""

    def __init__(self, gap: int, grace: int):
        self.gap, self.grace = gap, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.docs = handle.getListState("docs", "at long, pos long, text string")
        self.last = handle.getValueState("last", "at long")
        self.closed = handle.getValueState("closed", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh, late = [], []
        # Timers fire after a batch's rows; a set whose time had come before this batch is closed first.
        if self.last.exists() and timerValues.getCurrentWatermarkInMs() >= (due := self.last.get()[0] + self.gap - self.grace):
            self.handle.deleteTimer(due)
            yield self._close(key)
        closed = self.closed.get()[0] if self.closed.exists() else None
        for batch in rows:
            for at, pos, text in batch.sort_values("ms")[["ms", "pos", "text"]].itertuples(index=False):
                row = (int(at), int(pos), text)
                if closed is not None and at < closed + self.gap:
                    late.append(row)
                else:
                    fresh.append(row)
        if fresh:
            if closed is not None:
                self.closed.clear()
                self.handle.deleteTimer(closed + self.gap)
            before = self.last.get()[0] if self.last.exists() else None
            now = max([r[0] for r in fresh] + ([before] if before is not None else []))
            if before is not None:
                self.handle.deleteTimer(before + self.gap - self.grace)
            self.docs.appendList(fresh)
            self.last.update((now,))
            self.handle.registerTimer(now + self.gap - self.grace)
        if late:
            yield self._told(key, late, "late")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            self.closed.clear()
            return
        yield self._close(key)

    def _close(self, key) -> pd.DataFrame:
        last = self.last.get()[0]
        found = [tuple(r) for r in self.docs.get()]
        self.docs.clear()
        self.last.clear()
        self.closed.update((last,))
        self.handle.registerTimer(last + self.gap)
        return self._told(key, found, "closed")

    def _told(self, key, rows: list[tuple], status: str) -> pd.DataFrame:
        at, pos, text = zip(*rows)
        return pd.DataFrame({"set_id": key[0], "status": status, "at": pd.to_datetime(pd.Series(at), unit="ms"), "pos": pos, "text": text})

    def close(self) -> None:
        pass


def _milliseconds(span: timedelta) -> int:
    return span // timedelta(milliseconds=1)


def gathered(docs: DataFrame, set_col: str = "set_id", at_col: str = "at", pos_col: str = "pos", text_col: str = "text", delay: timedelta = timedelta(minutes=10), gap: timedelta = timedelta(minutes=30), grace: timedelta = timedelta(hours=1)) -> DataFrame:
    """(set_id, status, at, pos, text) of a stream of documents: those of sets as they are closed, and late ones."""
    gap_ms, grace_ms, delay_ms = map(_milliseconds, (gap, grace, delay))
    key = dict(docs.dtypes)[set_col]
    rows = docs.where(F.col(set_col).isNotNull() & F.col(at_col).isNotNull()).select(
        F.col(set_col).alias("set_id"), F.col(at_col).cast("timestamp").alias("at"), F.unix_millis(F.col(at_col).cast("timestamp")).alias("ms"), F.coalesce(F.col(pos_col).cast("long"), F.lit(0)).alias("pos"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    # The watermark waits `grace` longer, so that late rows come through; timers are set that much earlier.
    marked = rows.withWatermark("at", f"{delay_ms + grace_ms} milliseconds")
    return marked.groupBy("set_id").transformWithStateInPandas(Gather(gap_ms, grace_ms), f"set_id {key}, status string, at timestamp, pos long, text string", "Append", "EventTime")


def summarize_sets(docs: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, config: Config | None = None, lists: Lists = Lists(), trigger: dict | None = None, **how) -> StreamingQuery:
    """Start a query that hands (set_id, summary) of the sets that a micro-batch closed, and late documents (set_id, at, pos, text), to `sink`.

    `how` are the columns and times of `gathered`. What a micro-batch closes is written once below `checkpoint`, so the sink may read it as often
    as it likes, and a batch that is run again overwrites it. Documents of a set follow each other by time, then `pos`.
    """
    spark = docs.sparkSession

    def batch(rows: DataFrame, epoch: int) -> None:
        path = f"{checkpoint.rstrip('/')}-batches/{epoch}"
        rows.write.mode("overwrite").parquet(path)
        told = rows.sparkSession.read.schema(rows.schema).parquet(path)
        order = W.partitionBy("set_id").orderBy("at", "pos", "text")
        closed = told.where("status = 'closed'").withColumn("place", F.row_number().over(order))
        sink(summarize(closed, config or Config(), "set_id", "text", "place", lists), told.where("status = 'late'").drop("status"), epoch)

    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)  # keyed state with timers needs it; the query takes it along
    try:
        writer = gathered(docs, **how).writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)
