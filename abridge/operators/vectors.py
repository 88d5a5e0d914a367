"""Clusters of sparse sentence vectors, in all sets at once: Lloyd's rounds and repeated bisection. Centroids are tables of terms.

`vectors` is (set_id, i, term, w) with unit length in each sentence, `unit_vectors` makes them. Sentences without terms have no rows, and
belong to cluster 0. Every round is joins on (set, term) and partial sums, its state cut into the shared folder; sets that no longer gain are left.
Where each row is a set, `document_lloyd` and `document_bisection` give the same in one pass: dot products with means and sums are sums of cosines.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from abridge.config import Config
from abridge.operators.cluster import k_of
from abridge.operators.select import by_document, cosine_matrix, shared_checkpoints


def unit_vectors(weights: DataFrame) -> DataFrame:
    """(set_id, i, term, w) of tf-idf weights (set_id, sent_idx, term, tfidf); zero weights are left out."""
    rows = weights.where("tfidf <> 0").select("set_id", F.col("sent_idx").alias("i"), "term", "tfidf")
    size = rows.groupBy("set_id", "i").agg(F.sqrt(F.sum(F.col("tfidf") ** 2)).alias("size"))
    return rows.join(size, ["set_id", "i"]).select("set_id", "i", "term", (F.col("tfidf") / F.col("size")).alias("w"))


def _seeds(vectors: DataFrame, seed: int, k: Column | None) -> DataFrame:
    """(set_id, i, k): the first K sentences with a vector, in the order of md5(seed:index)."""
    sents = vectors.select("set_id", "i").distinct()
    order = W.partitionBy("set_id").orderBy(F.expr(f"md5(concat('{seed}:', i))"))
    ranked = sents.select("set_id", "i", (F.row_number().over(order) - 1).alias("k"), F.count("*").over(W.partitionBy("set_id")).alias("n"))
    return ranked.where(F.col("k") < (k_of(F.col("n")) if k is None else k)).select("set_id", "i", "k")


def centroids(vectors: DataFrame, clusters: DataFrame) -> DataFrame:
    """(set_id, k, term, c): means of the members' vectors."""
    size = clusters.groupBy("set_id", "k").agg(F.count("*").alias("n"))
    return vectors.join(clusters, ["set_id", "i"]).groupBy("set_id", "k", "term").agg(F.sum("w").alias("t")).join(size, ["set_id", "k"]).select("set_id", "k", "term", (F.col("t") / F.col("n")).alias("c"))


def nearest(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """(set_id, i, k, d): the nearest centroid, the lowest of equals, and the squared distance. Weights are not negative, so a centroid that shares no term
    is at best the one of least length, and all others are met by a join on terms."""
    length = centres.groupBy("set_id", "k").agg(F.sum(F.col("c") ** 2).alias("len"))
    met = vectors.join(centres, ["set_id", "term"]).groupBy("set_id", "i", "k").agg(F.sum(F.col("w") * F.col("c")).alias("dot")).join(length, ["set_id", "k"])
    met = met.select("set_id", "i", "k", F.round(1 + F.col("len") - 2 * F.col("dot"), 9).alias("d"))
    short = length.groupBy("set_id").agg(F.min(F.struct(F.round(1 + F.col("len"), 9).alias("d"), "k")).alias("m")).select("set_id", "m.k", "m.d")
    least = vectors.select("set_id", "i").distinct().join(short, "set_id").select("set_id", "i", "k", "d")
    best = met.union(least).groupBy("set_id", "i").agg(F.min(F.struct("d", "k")).alias("m"))
    return best.select("set_id", "i", F.col("m.k").alias("k"), F.col("m.d").alias("d"))


def repaired(assigned: DataFrame, kinds: DataFrame) -> DataFrame:
    """As `nearest`; the m-th cluster of `kinds` (set_id, k) without members takes the m-th farthest sentence of its set."""
    empty = kinds.join(assigned.select("set_id", "k").distinct(), ["set_id", "k"], "left_anti")
    place = lambda by: F.row_number().over(W.partitionBy("set_id").orderBy(*by))
    empty = empty.withColumn("r", place(["k"])).select("set_id", "r", F.col("k").alias("free"))
    far = assigned.join(empty.select("set_id").distinct(), "set_id", "left_semi").withColumn("r", place([F.desc("d"), "i"])).join(empty, ["set_id", "r"]).where("d > 0").select("set_id", "i", "free")
    return assigned.join(far, ["set_id", "i"], "left").select("set_id", "i", F.coalesce("free", "k").alias("k"), F.when(F.col("free").isNull(), F.col("d")).otherwise(0.0).alias("d"))


def lloyd(vectors: DataFrame, seed: int = 7, k: Column | None = None, rounds: int | None = None) -> DataFrame:
    """(set_id, i, k): k-means of each set's sentences, K by `cluster.k_of` or an expression of n. A set goes on while its summed squared
    distance falls, or for `rounds` rounds after the first assignment at most."""
    shared_checkpoints(vectors.sparkSession)
    vectors = vectors.checkpoint()
    seeds = _seeds(vectors, seed, k)
    kinds = seeds.select("set_id", "k").checkpoint()
    first = vectors.join(seeds, ["set_id", "i"]).select("set_id", "k", "term", F.col("w").alias("c"))
    state = repaired(nearest(vectors, first), kinds).checkpoint()
    done, live, n = None, vectors, 0
    while rounds is None or n < rounds:
        again = repaired(nearest(live, centroids(live, state.select("set_id", "i", "k"))), kinds).checkpoint()
        cost = lambda df, name: df.groupBy("set_id").agg(F.round(F.sum("d"), 9).alias(name))
        fell = cost(again, "now").join(cost(state, "before"), "set_id").where("now < before").select("set_id").checkpoint()
        ended = state.join(fell, "set_id", "left_anti")
        done = ended if done is None else done.union(ended)
        state = again.join(fell, "set_id", "left_semi").checkpoint()
        live, n = live.join(fell, "set_id", "left_semi"), n + 1
        if fell.isEmpty():
            break
    return (state if done is None else done.union(state)).select("set_id", "i", "k")


def _split(vectors: DataFrame, clusters: DataFrame, rounds: int) -> DataFrame:
    """(set_id, k, i, side, gain) of every cluster of two members or more: two halves, and by how much the summed lengths of the halves' sums exceed that of the whole.

    Halves begin with the member least like the whole, and the one least like that; members join the more similar one. A round moves each member
    to the half whose sum it is more like in direction, where that makes the lengths greater.
    """
    m = vectors.join(clusters, ["set_id", "i"])
    many = m.select("set_id", "k", "i").distinct().groupBy("set_id", "k").agg(F.count("*").alias("n")).where("n > 1").select("set_id", "k")
    m = m.join(many, ["set_id", "k"], "left_semi").select("set_id", "k", "i", "term", "w").checkpoint()
    whole = m.groupBy("set_id", "k", "term").agg(F.sum("w").alias("x"))
    like = lambda other: m.join(other, ["set_id", "k", "term"], "left").groupBy("set_id", "k", "i").agg(F.sum(F.col("w") * F.coalesce("x", F.lit(0.0))).alias("s"))
    least = lambda sims: sims.groupBy("set_id", "k").agg(F.min(F.struct(F.round("s", 9).alias("s"), "i")).alias("m")).select("set_id", "k", F.col("m.i").alias("i"))
    of = lambda ids: m.join(ids, ["set_id", "k", "i"], "left_semi").select("set_id", "k", "term", F.col("w").alias("x"))
    a = least(like(whole)).checkpoint()
    to_a = like(of(a)).checkpoint()
    b = least(to_a.join(a, ["set_id", "k", "i"], "left_anti")).checkpoint()
    both = to_a.join(like(of(b)).withColumnRenamed("s", "t"), ["set_id", "k", "i"])
    # the second seed is a half of its own, were it as like the first as itself
    sides = both.join(b.withColumn("second", F.lit(True)), ["set_id", "k", "i"], "left").select("set_id", "k", "i", F.when(F.col("second") | (F.round("t", 9) > F.round("s", 9)), 1).otherwise(0).alias("side"))
    lengths = lambda sides: _sums(m, sides).groupBy("set_id", "k", "side").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("len"))
    now = sides.checkpoint()
    total = lambda lens: lens.groupBy("set_id", "k").agg(F.sum("len").alias("total"))
    lens = lengths(now).checkpoint()
    for _ in range(rounds):
        sims = m.join(_sums(m, now), ["set_id", "k", "term"]).groupBy("set_id", "k", "i", "side").agg(F.sum(F.col("w") * F.col("x")).alias("s")).join(lens, ["set_id", "k", "side"])
        better = sims.groupBy("set_id", "k", "i").agg(F.max(F.struct(F.round(F.col("s") / F.col("len"), 9).alias("s"), (-F.col("side")).alias("ns"))).alias("m")).select("set_id", "k", "i", (-F.col("m.ns")).alias("side")).checkpoint()
        other = lengths(better).checkpoint()
        rose = total(other).withColumnRenamed("total", "after").join(total(lens), ["set_id", "k"]).where("round(after, 9) > round(total, 9)").select("set_id", "k").checkpoint()
        pick = lambda new, old: new.join(rose, ["set_id", "k"], "left_semi").union(old.join(rose, ["set_id", "k"], "left_anti"))  # noqa: B023, E731
        now, lens = pick(better, now).checkpoint(), pick(other, lens).checkpoint()
    before = whole.groupBy("set_id", "k").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("len"))
    gain = total(lens).join(before, ["set_id", "k"]).select("set_id", "k", F.round(F.col("total") - F.col("len"), 9).alias("gain"))
    return now.join(gain, ["set_id", "k"])


def _sums(m: DataFrame, sides: DataFrame) -> DataFrame:
    return m.join(sides, ["set_id", "k", "i"]).groupBy("set_id", "k", "side", "term").agg(F.sum("w").alias("x"))


def repeated_bisection(vectors: DataFrame, k: Column | None = None, rounds: int = 1, levels: int | None = None) -> DataFrame:
    """(set_id, i, k): each set is one cluster at first; level after level the cluster whose halves gain most is split, the lowest of equals, until there are K
    (`cluster.k_of`, or an expression of n), `levels` were made, or nothing gains. Halves of a cluster are made once, when it appears. The summed length of the clusters' sums never falls."""
    shared_checkpoints(vectors.sparkSession)
    vectors = vectors.checkpoint()
    sents = vectors.select("set_id", "i").distinct()
    wanted = sents.groupBy("set_id").agg(F.count("*").alias("n")).select("set_id", (k_of(F.col("n")) if k is None else k).alias("most")).checkpoint()
    clusters = sents.select("set_id", "i", F.lit(0).alias("k")).checkpoint()
    halves, fresh, level = None, clusters.join(wanted.where("most > 1"), "set_id", "left_semi"), 0
    while levels is None or level < levels:
        new = _split(vectors, fresh, rounds)
        halves = (new if halves is None else halves.union(new)).checkpoint()
        level += 1
        best = halves.where("gain > 0").select("set_id", "k", "gain").distinct().groupBy("set_id").agg(F.max(F.struct("gain", (-F.col("k")).alias("nk"))).alias("m"))
        best = best.join(wanted.where(F.col("most") > level), "set_id").select("set_id", (-F.col("m.nk")).alias("k")).checkpoint()
        if best.isEmpty():
            break
        cut = halves.join(best, ["set_id", "k"], "left_semi").select("set_id", "i", "side").checkpoint()
        clusters = clusters.join(cut, ["set_id", "i"], "left").select("set_id", "i", F.when(F.col("side") == 1, level).otherwise(F.col("k")).alias("k")).checkpoint()
        halves = halves.join(best, ["set_id", "k"], "left_anti")
        fresh = clusters.join(cut.select("set_id", "i"), ["set_id", "i"], "left_semi")
    return clusters


def composite_length(vectors: DataFrame, clusters: DataFrame) -> DataFrame:
    """(set_id, total): what repeated bisection makes greater, the summed lengths of the clusters' sums."""
    lens = vectors.join(clusters, ["set_id", "i"]).groupBy("set_id", "k", "term").agg(F.sum("w").alias("x")).groupBy("set_id", "k").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("len"))
    return lens.groupBy("set_id").agg(F.sum("len").alias("total"))


def _document_clusters(docs: DataFrame, config: Config, stop: tuple[str, ...], run) -> DataFrame:
    """(set_id, sent_idx, k) of the sentences that have a vector; `run` takes their cosines and their numbers."""

    def of_row(sent, term, weight, n):
        held = np.unique(sent)
        g = cosine_matrix(sent, term, weight, n)
        return held, run(g if len(held) == n else g[np.ix_(held, held)], held)

    return by_document(docs, config, of_row, {"sent_idx": "int", "k": "int"}, stop)


def document_lloyd(docs: DataFrame, config: Config, stop: tuple[str, ...] = (), rounds: int | None = None) -> DataFrame:
    """(set_id, sent_idx, k): `lloyd` of the tf-idf vectors of each document's sentences, in one pass and without a shuffle."""

    def run(g, held):
        order = sorted(range(len(held)), key=lambda p: hashlib.md5(f"{config.seed}:{held[p]}".encode()).hexdigest())
        return kernel_lloyd(g, order[: max(1, int(0.2 * len(held) + 0.5))], rounds)

    return _document_clusters(docs, config, stop, run)


def document_bisection(docs: DataFrame, config: Config, stop: tuple[str, ...] = (), rounds: int = 1, levels: int | None = None) -> DataFrame:
    """(set_id, sent_idx, k): `repeated_bisection` of the tf-idf vectors of each document's sentences, in one pass and without a shuffle."""
    return _document_clusters(docs, config, stop, lambda g, held: kernel_bisection(g, max(1, int(0.2 * len(held) + 0.5)), rounds, levels))


def kernel_lloyd(g: np.ndarray, seeds: list[int], rounds: int | None = None) -> np.ndarray:
    """`lloyd` of one set from the dot products `g` of its unit vectors."""
    n, k = len(g), len(seeds)
    if not n:
        return np.zeros(0, np.int64)

    def assign(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`nearest` and `repaired`; a row of `share` has what each vector is of a centroid."""
        dots = share @ g
        d = np.round(1 + (dots * share).sum(axis=1)[:, None] - 2 * dots, 9)
        d[~share.any(axis=1)] = np.inf
        out, cost = d.argmin(axis=0), d.min(axis=0)
        free = np.setdiff1d(np.arange(k), out)
        for c, i in zip(free, np.argsort(-cost, kind="stable")[: len(free)]):
            if cost[i] > 0:
                out[i], cost[i] = c, 0.0
        return out, cost

    def means(out: np.ndarray) -> np.ndarray:
        share = np.zeros((k, n))
        share[out, np.arange(n)] = 1 / np.bincount(out, minlength=k)[out]
        return share

    first = np.zeros((k, n))
    first[np.arange(k), seeds] = 1.0
    out, cost = assign(first)
    while rounds is None or rounds > 0:
        again, now = assign(means(out))
        if not np.round(now.sum(), 9) < np.round(cost.sum(), 9):
            break
        out, cost, rounds = again, now, None if rounds is None else rounds - 1
    return out


def _halves(g: np.ndarray, members: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """(side of each member, gain) of one cluster, as `_split`."""
    s = g[np.ix_(members, members)]
    a = np.round(s.sum(axis=1), 9).argmin()
    to_a = np.round(s[:, a], 9)
    b = np.where(np.arange(len(s)) == a, np.inf, to_a).argmin()
    side = (np.round(s[:, b], 9) > to_a).astype(np.int64)
    side[b] = 1

    def lengths(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        is_in = np.stack([side == 0, side == 1], axis=1).astype(float)
        sums = s @ is_in
        return sums, np.sqrt((sums * is_in).sum(axis=0))

    sums, lens = lengths(side)
    for _ in range(rounds):
        better = np.round(sums / np.where(lens > 0, lens, 1), 9).argmax(axis=1)
        now, other = lengths(better)
        if not np.round(other.sum(), 9) > np.round(lens.sum(), 9):
            break
        side, sums, lens = better, now, other
    return side, float(np.round(lens.sum() - np.sqrt(s.sum()), 9))


def kernel_bisection(g: np.ndarray, most: int, rounds: int = 1, levels: int | None = None) -> np.ndarray:
    """`repeated_bisection` of one set from the dot products `g` of its unit vectors."""
    out, halves, fresh, level = np.zeros(len(g), np.int64), {}, [0], 0
    while level + 1 < most and (levels is None or level < levels):
        for k in fresh:
            members = np.flatnonzero(out == k)
            if len(members) > 1:
                halves[k] = members, *_halves(g, members, rounds)
        gains = [(gain, -k) for k, (_, _, gain) in halves.items() if gain > 0]
        if not gains:
            break
        level, k = level + 1, -max(gains)[1]
        members, side, _ = halves.pop(k)
        out[members[side == 1]] = level
        fresh = [k, level]
    return out
