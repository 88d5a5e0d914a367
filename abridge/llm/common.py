"""Shared plumbing of the operators: tables, lineage cuts, distributed connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch of rows that goes to Python at once; Spark's own limit is eight times that, and a task holds several.
BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on batches of this session that go to Python hold BATCH bytes at most, or one row."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it is unset, a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    own = sc._jsc.sc().getCheckpointDir()
    if named is None:
        if own.isEmpty() and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = own.get() if own.isDefined() else tempfile.mkdtemp(prefix="abridge-")
    if own.isEmpty():
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint; its files survive a lost executor. They stay unless spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def run_folder(spark: SparkSession) -> str:
    """The folder of this run below the shared one; it goes when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{shared_dir(spark).rstrip('/')}/abridge-{app}-{uuid.uuid4().hex}"
        atexit.register(_remove_at_end, spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf(), _runs[app])
    return _runs[app]


_runs: dict[str, str] = {}


def _remove(jvm, conf, path: str) -> None:
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def _remove_at_end(jvm, conf, path: str) -> None:
    with suppress(Exception):  # the JVM may have gone first
        _remove(jvm, conf, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet below the run's folder and read it back: a lineage cut with column pruning."""
    path = f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


_scope: ContextVar[list[DataFrame] | None] = ContextVar("abridge_scratch", default=None)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """What `kept` writes within goes at the end, after an error too. Scopes of other threads, and those around this one, are left alone."""
    own: list[DataFrame] = []
    token = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(token)
        discard(*own)


def kept(df: DataFrame, name: str = "part") -> DataFrame:
    """As `stored`, for what is read within the `scratch` around it alone."""
    out = stored(df, name)
    if (own := _scope.get()) is not None:
        own.append(out)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what `stored` wrote for these frames; nothing may read them any more."""
    for df in frames:
        spark = df.sparkSession
        _remove(spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf(), df._stored_at)


_caches: dict[str, dict] = {}


def worker_cache(operator: str) -> dict:
    """What a Python worker remembers for an operator. Workers are used again; asking drops what other operators have left in them."""
    if operator not in _caches:
        _caches.clear()
        _caches[operator] = {}
    return _caches[operator]


#: Links that a task joins up at once, 16 bytes each.
FOREST = 1 << 20


def _forest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node) that join what the given links join: at most one for each node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            break
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while not np.array_equal(up := root[root], root):
            root = up
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def forests(links: DataFrame) -> DataFrame:
    """Links (a, b), a > b, that join the same nodes: each task gives a forest of its own links. Nothing is shuffled."""

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            a, b = _forest_of(*(np.concatenate(v) for v in zip(*held)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in range(2)])
            n += batch.num_rows
            if n >= FOREST:
                yield out()
                n = 0
        if held:
            yield out()

    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(join_up, "a long, b long")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links, longs -> (node, root): root is the smallest node reachable. Nodes are those of the links.

    First each task turns the links that it holds into a forest, one link a node at most, before any of them is shuffled. Then rounds
    alternate two contractions until nothing changes: every node points its larger neighbours at the smallest node it sees, then its
    smaller ones; what a task gets out of a round is made a forest again. Links live in the shared folder, those of a round go
    when the next is written; no node's neighbours are ever gathered in one place. The number of
    rounds grows with the logarithm of the longest chain at most. The way is the same for few links and many.
    """
    small_batches(edges.sparkSession)
    given = edges.where("a <> b").select("a", "b")
    links = kept(forests(forests(given).distinct()), "links")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = links.agg(mark).first()[0]
    for _ in range(max_rounds):
        sides = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = (
            sides.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.where("m < a").select("a", F.col("m").alias("b")))
            .distinct()
        )
        low2 = big.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            big.join(low2, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low2.select("a", F.col("m").alias("b")))
            .distinct()
        )
        after_round = kept(forests(small).distinct(), "links")
        discard(links)
        links = after_round
        after = links.agg(mark).first()[0]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("root"))
    ).distinct()
