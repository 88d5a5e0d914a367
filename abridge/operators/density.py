"""Clusters by density in all sets at once, and a sweep over thresholds and least numbers of neighbours.

`pairs` is (set_id, i, j, s), i < j; the distance of a pair is 1 - s, of a pair that is not there 1. A sentence with at least `least` sentences within
`eps`, itself counted, is a core; cores within eps of each other are one cluster, others join their most similar core, or are noise (-1).
A pair joins two cores from the distance on at which it is near enough and both have enough neighbours. So each pair has one place
in a sweep of growing distances, and clusters only grow together: the sweep reads every pair once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from abridge.operators.cluster import both_ways, k_of
from abridge.operators.select import shared_checkpoints


def components(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, node, root) of links (*keys, a, b): root is the least node reachable within the keys. Rounds of two contractions until nothing
    changes, each a join and minima over links in the shared folder; their number grows with the logarithm of the longest chain."""
    keys = list(keys)
    shared_checkpoints(links.sparkSession)
    links = links.where("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
    before = print_of(links)
    while before[0]:
        sides = links.union(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = sides.groupBy(*keys, "a").agg(F.min("b").alias("m")).select(*keys, "a", F.least("a", "m").alias("m"))
        big = sides.join(low, [*keys, "a"]).where("b > a").select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).union(low.where("m < a").select(*keys, "a", F.col("m").alias("b"))).distinct()
        low2 = big.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = big.join(low2, [*keys, "a"]).where("b > m").select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).union(low2.select(*keys, "a", F.col("m").alias("b"))).distinct()
        links = small.checkpoint()
        if (now := print_of(links)) == before:
            break
        before = now
    return links.select(*keys, F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(*keys, F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def core_similarity(pairs: DataFrame, least: Sequence[int]) -> DataFrame:
    """(set_id, least, i, core): the similarity from which on a sentence has `least` sentences around it, itself counted; those that never have are left out."""
    deep = max(least)
    place = F.row_number().over(W.partitionBy("set_id", "i").orderBy(F.desc("s"), "j"))
    ranked = both_ways(pairs).where("s > 0").select("set_id", "i", "j", F.round("s", 9).alias("s")).withColumn("r", place + 1).where(F.col("r") <= deep)
    found = ranked.where(F.col("r").isin(*[m for m in least if m > 1])).select("set_id", F.col("r").alias("least"), "i", F.col("s").alias("core"))
    if 1 in least:
        found = found.union(both_ways(pairs).select("set_id", F.lit(1).alias("least"), "i", F.lit(1.0).alias("core")).distinct())
    return found


def _labelled(sents: DataFrame, sides: DataFrame, cores: DataFrame, roots: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """(*keys, sent_idx, k) for the cores (*keys, i) and their roots (*keys, i, root); clusters are numbered by their first core, `sents` has (*keys, sent_idx)."""
    own = cores.join(roots, [*keys, "i"], "left").select(*keys, "i", F.coalesce("root", "i").alias("root"))
    number = own.select(*keys, "root").distinct().withColumn("k", (F.row_number().over(W.partitionBy(*keys).orderBy("root")) - 1).cast("int"))
    own = own.join(number, [*keys, "root"]).select(*keys, "i", "k")
    near = sides.where(F.col("s") >= threshold).join(own.select(*keys, F.col("i").alias("j"), "k"), [*([c for c in keys if c in sides.columns]), "j"])
    border = near.groupBy(*keys, "i").agg(F.max(F.struct("s", (-F.col("j")).alias("nj"), "k")).alias("m")).select(*keys, "i", F.col("m.k").alias("edge"))
    rows = sents.withColumnRenamed("sent_idx", "i").join(own, [*keys, "i"], "left").join(border, [*keys, "i"], "left")
    return rows.select(*keys, F.col("i").alias("sent_idx"), F.coalesce("k", "edge", F.lit(-1)).alias("k"))


def density_clusters(sents: DataFrame, pairs: DataFrame, eps: float, least: int) -> DataFrame:
    """(set_id, sent_idx, k) for one distance and one number of neighbours; noise is -1."""
    threshold = round(1 - eps, 9)
    shared_checkpoints(sents.sparkSession)
    # only pairs within eps count: they are made once, and all else is read from what is left
    near = pairs.select("set_id", "i", "j", F.round("s", 9).alias("s")).where((F.col("s") > 0) & (F.col("s") >= threshold)).checkpoint()
    sides = both_ways(near)
    cores = sides.groupBy("set_id", "i").agg(F.count("*").alias("n")).where(F.col("n") >= least - 1).select("set_id", "i")
    if least <= 1:
        cores = sents.select("set_id", F.col("sent_idx").alias("i"))
    both = sides.where((F.col("s") >= threshold) & (F.col("i") < F.col("j"))).join(cores, ["set_id", "i"]).join(cores.withColumnRenamed("i", "j"), ["set_id", "j"])
    roots = components(both.select("set_id", F.col("i").alias("a"), F.col("j").alias("b")), ["set_id"]).select("set_id", F.col("node").alias("i"), "root")
    return _labelled(sents.select("set_id", "sent_idx"), sides, cores, roots, threshold, ["set_id"])


def density_sweep(sents: DataFrame, pairs: DataFrame, distances: Sequence[float], least: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """What each distance and number of neighbours gives: (set_id, least, eps, clusters, cores), and the labels (set_id, least, eps, i, root) of cores.

    Distances are taken from the smallest on. A pair is read where it first joins two cores, with the clusters so far for its ends.
    """
    shared_checkpoints(sents.sparkSession)
    keys, least = ["set_id", "least"], sorted({max(2, m) for m in least})
    distances = sorted(set(distances))
    cores = core_similarity(pairs, least).checkpoint()
    ends = pairs.where("s > 0").select("set_id", "i", "j", F.round("s", 9).alias("s")).join(cores, ["set_id", "i"]).join(cores.select("set_id", "least", F.col("i").alias("j"), F.col("core").alias("other")), ["set_id", "least", "j"])
    # the first distance at which a pair joins, or a sentence is a core
    first = lambda s: F.coalesce(*[F.when(s >= round(1 - eps, 9), n) for n, eps in enumerate(distances)])
    edges = ends.select(*keys, "i", "j", first(F.least("s", "core", "other")).alias("n")).where("n IS NOT NULL").checkpoint()
    begun = cores.select(*keys, "i", first(F.col("core")).alias("n")).where("n IS NOT NULL").checkpoint()
    roots, labels, counts = None, None, None
    for n, eps in enumerate(distances):
        fresh = edges.where(F.col("n") == n).select(*keys, F.col("i").alias("a"), F.col("j").alias("b"))
        if roots is not None:
            for side in "ab":
                fresh = fresh.join(roots.select(*keys, F.col("i").alias(side), "root"), [*keys, side], "left").withColumn(side, F.coalesce("root", side)).drop("root")
        merged = components(fresh.select(*keys, "a", "b"), keys).select(*keys, F.col("node").alias("old"), F.col("root").alias("new"))
        now = begun.where(F.col("n") <= n).select(*keys, "i")
        now = (now.join(roots, [*keys, "i"], "left") if roots is not None else now.withColumn("root", F.lit(None).cast("int"))).select(*keys, "i", F.coalesce("root", "i").alias("old"))
        roots = now.join(merged, [*keys, "old"], "left").select(*keys, "i", F.coalesce("new", "old").alias("root")).checkpoint()
        told = roots.select(*keys, F.lit(float(eps)).alias("eps"), "i", "root")
        labels = told if labels is None else labels.union(told)
    tried = sents.select("set_id").distinct().select("set_id", F.explode(F.array(*map(F.lit, least))).alias("least")).select(*keys, F.explode(F.array(*[F.lit(float(e)) for e in distances])).alias("eps"))
    counts = labels.groupBy(*keys, "eps").agg(F.countDistinct("root").alias("clusters"), F.count("*").alias("cores"))
    return tried.join(counts, [*keys, "eps"], "left").fillna(0, ["clusters", "cores"]), labels


def density_best(sents: DataFrame, pairs: DataFrame, distances: Sequence[float] = tuple(k / 20 for k in range(1, 20)), least: Sequence[int] = (2, 3, 4)) -> DataFrame:
    """(set_id, eps, least, sent_idx, k): of a sweep, for each set the clustering whose number of clusters is nearest to `cluster.k_of`; of equal ones
    that with most cores, then the least distance and number. A set without any cluster is all noise."""
    counts, labels = density_sweep(sents, pairs, distances, least)
    wanted = sents.groupBy("set_id").agg(F.count("*").alias("n")).select("set_id", k_of(F.col("n")).alias("want"))
    best = counts.join(wanted, "set_id").groupBy("set_id").agg(F.min(F.struct(F.abs(F.col("clusters") - F.col("want")).alias("off"), (-F.col("cores")).alias("nc"), "eps", "least")).alias("m"))
    best = best.select("set_id", F.col("m.eps").alias("eps"), F.col("m.least").alias("least")).checkpoint()
    keys = ["set_id", "least", "eps"]
    roots = labels.join(best, keys, "left_semi").checkpoint()
    sides = both_ways(pairs).where("s > 0").select("set_id", "i", "j", F.round("s", 9).alias("s")).join(best, "set_id").where(F.col("s") >= F.round(1 - F.col("eps"), 9))
    return _labelled(sents.select("set_id", "sent_idx").join(best, "set_id").select(*keys, "sent_idx"), sides, roots.select(*keys, "i"), roots, 0.0, keys).select("set_id", "eps", "least", "sent_idx", "k")
