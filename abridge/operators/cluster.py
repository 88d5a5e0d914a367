"""k-medoids of each set's sentences. Steps as DataFrame operators, and all rounds as a numpy kernel for one set."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from abridge.functions.text import word_array


def k_of(n: Column) -> Column:
    """0.2 n rounded, 1 at least."""
    return F.greatest(F.lit(1), F.floor(0.2 * n + 0.5).cast("int"))


def seeded_medoids(sents: DataFrame, seed: int = 7, k: Column | None = None) -> DataFrame:
    """(set_id, k, medoid): the first K sentences of a set in the order of md5(seed:index); K by `k_of`, or an expression of n."""
    order = W.partitionBy("set_id").orderBy(F.expr(f"md5(concat('{seed}:', sent_idx))"))
    ranked = sents.select("set_id", "sent_idx", (F.row_number().over(order) - 1).alias("k"), F.count("*").over(W.partitionBy("set_id")).alias("n"))
    return ranked.where(F.col("k") < (k_of(F.col("n")) if k is None else k)).select("set_id", "k", F.col("sent_idx").alias("medoid"))


def by_shared_words(sents: DataFrame, seed: int = 7) -> DataFrame:
    """(set_id, sent_idx, k): each sentence with the seeded medoid that shares most distinct words with it, as `assigned` has it. A set's words are gathered in a row
    (they are a document), and its medoids are met there, some sentences at a time."""
    rows = sents.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("sent_idx", F.array_distinct("words").alias("words")))).alias("s"))  # of one set
    rows = rows.select("set_id", F.col("s.sent_idx").alias("ids"), F.col("s.words").alias("words"))

    def run(batches):
        for batch in batches:
            sets, ids, found = [], [], []
            for r in range(batch.num_rows):
                own, words = batch.column(1)[r].values.to_numpy(), batch.column(2)[r].values
                length = pc.list_value_length(words).to_numpy(zero_copy_only=False)
                code = pc.dictionary_encode(words.flatten()).indices.to_numpy()
                out = shared_word_clusters(own, np.repeat(np.arange(len(own)), length), code, seed)
                sets.append(np.full(len(own), r))
                ids.append(own)
                found.append(out)
            if sets:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(sets))), pa.array(np.concatenate(ids), pa.int32()), pa.array(np.concatenate(found), pa.int32())], ["set_id", "sent_idx", "k"])

    return rows.mapInArrow(run, f"set_id {dict(rows.dtypes)['set_id']}, sent_idx int, k int")


def rows_by_shared_words(rows: DataFrame, seed: int = 7) -> DataFrame:
    """(set_id, ks): `by_shared_words` where each row (set_id, sents) is a set, sents as `text.sentences_of` has them; nothing is shuffled."""
    rows = rows.select("set_id", F.transform("sents", lambda s: F.array_distinct(word_array(s["tokens"]))).alias("words"))

    def run(batches):
        for batch in batches:
            found = []
            for r in range(batch.num_rows):
                words = batch.column(1)[r].values
                length = pc.list_value_length(words).to_numpy(zero_copy_only=False)
                code = pc.dictionary_encode(words.flatten()).indices.to_numpy()
                found.append(shared_word_clusters(np.arange(len(words)), np.repeat(np.arange(len(words)), length), code, seed) if len(words) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["set_id", "ks"])

    return rows.mapInArrow(run, f"set_id {dict(rows.dtypes)['set_id']}, ks array<int>")


def shared_word_clusters(ids: np.ndarray, sent: np.ndarray, word: np.ndarray, seed: int) -> np.ndarray:
    """`by_shared_words` of one set: cells (place of a sentence, number of a word), each once; `ids` are the sentences' numbers."""
    n = len(ids)
    medoids = np.array(sorted(range(n), key=lambda p: hashlib.md5(f"{seed}:{ids[p]}".encode()).hexdigest())[: max(1, int(0.2 * n + 0.5))])
    kind = np.full(n, -1)
    kind[medoids] = np.arange(len(medoids))
    order = np.argsort(word, kind="stable")
    of = order[kind[sent[order]] >= 0]  # cells of medoids, by word
    first = np.searchsorted(word[of], np.arange(int(word.max(initial=-1)) + 2))
    met = np.diff(first)
    out = np.zeros(n, np.int64)
    step = max(1, (1 << 21) // len(medoids))
    for low in range(0, n, step):
        a, b = np.searchsorted(sent, [low, low + step])
        many = met[word[a:b]]
        at = np.repeat(first[word[a:b]] - np.cumsum(many) + many, many) + np.arange(many.sum())
        rows = min(step, n - low)
        shared = np.bincount(np.repeat(sent[a:b] - low, many) * len(medoids) + kind[sent[of[at]]], minlength=rows * len(medoids)).reshape(rows, -1)
        out[low : low + rows] = shared.argmax(axis=1)  # the lowest of equals, and of none
    out[medoids] = np.arange(len(medoids))
    return out


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("set_id", "i", "j", "s").union(pairs.select("set_id", F.col("j").alias("i"), F.col("i").alias("j"), "s"))


def assigned(sents: DataFrame, medoids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(set_id, sent_idx, k): a medoid's own cluster; else the most similar medoid's, if above 0, the lowest of equals; else cluster 0."""
    sides = both_ways(pairs).where("s > 0")
    near = sides.join(medoids.withColumnRenamed("medoid", "j"), ["set_id", "j"]).groupBy("set_id", F.col("i").alias("sent_idx")).agg(F.max(F.struct(F.round("s", 9).alias("s"), (-F.col("k")).alias("nk"))).alias("m"))
    own = medoids.select("set_id", F.col("medoid").alias("sent_idx"), F.col("k").alias("own"))
    rows = sents.select("set_id", "sent_idx").join(own, ["set_id", "sent_idx"], "left").join(near, ["set_id", "sent_idx"], "left")
    return rows.select("set_id", "sent_idx", F.coalesce("own", -F.col("m.nk"), F.lit(0)).cast("int").alias("k"))


def best_medoids(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """(set_id, k, medoid, total): the member of greatest similarity to the others of its cluster, the first of equals."""
    c = clusters.select("set_id", F.col("sent_idx").alias("i"), "k")
    inside = both_ways(pairs).join(c, ["set_id", "i"]).join(c.withColumnRenamed("i", "j").withColumnRenamed("k", "kj"), ["set_id", "j"]).where("k = kj")
    total = c.join(inside.groupBy("set_id", "i").agg(F.sum("s").alias("total")), ["set_id", "i"], "left").withColumn("total", F.round(F.coalesce("total", F.lit(0.0)), 9))
    best = total.groupBy("set_id", "k").agg(F.max(F.struct("total", (-F.col("i")).alias("ni"))).alias("m"))
    return best.select("set_id", "k", (-F.col("m.ni")).alias("medoid"), F.col("m.total").alias("total"))


def utility(clusters: DataFrame, medoids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(set_id, utility): similarities of sentences to the medoid of their cluster."""
    m = clusters.join(medoids.select("set_id", "k", "medoid"), ["set_id", "k"]).select("set_id", F.col("sent_idx").alias("i"), F.col("medoid").alias("j"))
    found = m.join(both_ways(pairs), ["set_id", "i", "j"]).groupBy("set_id").agg(F.sum("s").alias("u"))
    return clusters.select("set_id").distinct().join(found, "set_id", "left").select("set_id", F.coalesce("u", F.lit(0.0)).alias("utility"))


def seeded_order(n: int, seed: int) -> list[int]:
    return sorted(range(n), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())


def kernel_assign(w: np.ndarray, medoids: list[int]) -> np.ndarray:
    near = np.round(w[:, medoids], 9)
    out = np.where(near.max(axis=1) > 0, near.argmax(axis=1), 0)
    out[medoids] = np.arange(len(medoids))
    return out


def kernel_best_medoids(off: np.ndarray, clusters: np.ndarray, k: int) -> tuple[list[int], list[float]]:
    """`best_medoids` of one set: the medoid of each cluster and its summed similarity to the others."""
    found, totals = [], []
    for c in range(k):
        members = np.flatnonzero(clusters == c)
        total = np.round(off[np.ix_(members, members)].sum(axis=1), 9)
        found.append(int(members[total.argmax()]))
        totals.append(float(total.max()))
    return found, totals


def kernel_medoids(w: np.ndarray, seed: int = 7, k: int | None = None) -> np.ndarray:
    """Cluster of each sentence of one set: rounds of new medoids and reassignment while the utility rises. It rises finitely often."""
    n = len(w)
    k = k or max(1, int(0.2 * n + 0.5))
    off = w.copy()
    np.fill_diagonal(off, 0)
    medoids = seeded_order(n, seed)[:k]
    out = kernel_assign(off, medoids)
    score = lambda c, m: round(float(off[np.arange(n), np.array(m)[c]].sum()), 9)
    best = score(out, medoids)
    while True:
        new = kernel_best_medoids(off, out, k)[0]
        again = kernel_assign(off, new)
        if (now := score(again, new)) <= best:
            break
        out, medoids, best = again, new, now
    return out


def kmedoids(sents: DataFrame, pairs: DataFrame, seed: int = 7, k: Column | None = None) -> DataFrame:
    """(set_id, sent_idx, k): `kernel_medoids` for all sets at once, as joins; sets whose utility no longer rises keep their clusters.

    A round is a step of the driver with its state in the shared folder; rounds go on until no set's utility rises.
    """
    pairs = pairs.checkpoint()
    medoids = seeded_medoids(sents, seed, k)
    now = assigned(sents, medoids, pairs)
    state = now.join(utility(now, medoids, pairs), "set_id").withColumn("utility", F.round("utility", 9)).checkpoint()
    while True:
        clusters = state.select("set_id", "sent_idx", "k")
        new = best_medoids(clusters, pairs).select("set_id", "k", "medoid").checkpoint()
        again = assigned(sents, new, pairs)
        rose = utility(again, new, pairs).select("set_id", F.round("utility", 9).alias("now")).join(state.select("set_id", "utility").distinct(), "set_id").where("now > utility").select("set_id", "now").checkpoint()
        if rose.isEmpty():
            return clusters
        moved = again.join(rose, "set_id").select("set_id", "sent_idx", "k", F.col("now").alias("utility"))
        state = state.join(rose.select("set_id"), "set_id", "left_anti").select("set_id", "sent_idx", "k", "utility").union(moved).checkpoint()


def kernel_distance_medoids(d: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Clusters of one set from distances: the first k items begin clusters of their own, others by md5(seed:index) mod k. Rounds until
    nothing changes: the centre of a cluster is the member of least summed distance, each item goes to the nearest centre, the lowest of equals. An empty cluster's centre is item 0."""
    n = len(d)
    out = np.array([i if i < k else int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), 16) % k for i in range(n)])
    seen = set()
    while out.tobytes() not in seen:  # a state met again would go round for ever
        seen.add(out.tobytes())
        centres = []
        for c in range(k):
            members = np.flatnonzero(out == c)
            centres.append(int(members[np.round(d[np.ix_(members, members)].sum(axis=1), 9).argmin()]) if len(members) else 0)
        out = np.round(d[:, centres], 9).argmin(axis=1)
    return out


def kernel_swap_gains(off: np.ndarray, medoids: list[int], place: int) -> np.ndarray:
    """By how much the utility rises if the medoid at `place` is swapped for each sentence; -inf for medoids."""
    n, m = len(off), np.array(medoids)
    near = off[:, m]
    is_medoid = np.zeros(n, bool)
    is_medoid[m] = True
    now = np.where(is_medoid, 0.0, np.maximum(near.max(axis=1), 0.0))
    rest = np.delete(near, place, axis=1)
    rest = np.maximum(rest.max(axis=1), 0.0) if rest.shape[1] else np.zeros(n)
    stay = is_medoid.copy()
    stay[m[place]] = False
    after = np.where(stay[:, None], 0.0, np.maximum(rest[:, None], off))  # (sentence, candidate)
    np.fill_diagonal(after, 0.0)
    gain = after.sum(axis=0) - now.sum()
    gain[m] = -np.inf
    return gain


def kernel_pam(w: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Clusters of one set by partitioning around medoids: a medoid is swapped for the first other item that raises the utility, until no swap does.
    Similarities are not negative."""
    off = w.copy()
    np.fill_diagonal(off, 0)
    medoids, rising = seeded_order(len(w), seed)[:k], True
    while rising:
        rising = False
        for place in range(k):
            better = np.round(kernel_swap_gains(off, medoids, place), 9) > 0
            if better.any():
                medoids[place], rising = int(better.argmax()), True
    return kernel_assign(off, medoids)


def swap_gains(sents: DataFrame, medoids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(set_id, k, sent_idx, gain): by how much the utility rises if the medoid of cluster k is swapped for another sentence.

    From each sentence's similarity to its nearest and second-nearest medoid: a sentence whose nearest medoid stays can only gain; one that
    loses it goes to the new medoid or to its second. So nothing is assigned anew, and pairs are joined once for all swaps. Similarities are not negative.
    """
    own = medoids.select("set_id", F.col("medoid").alias("i"), F.lit(True).alias("own"))
    sides = both_ways(pairs).where("s > 0")
    to = sides.join(medoids.select("set_id", F.col("medoid").alias("j"), F.col("k").alias("to")), ["set_id", "j"])
    two = F.slice(F.sort_array(F.collect_list(F.struct((-F.round("s", 9)).alias("o"), F.col("to").alias("to"), F.col("s").alias("s")))), 1, 2)
    near = to.groupBy("set_id", "i").agg(two.alias("t")).select("set_id", "i", F.get("t", F.lit(0))["to"].alias("k1"), F.get("t", F.lit(0))["s"].alias("d1"), F.coalesce(F.get("t", F.lit(1))["s"], F.lit(0.0)).alias("d2"))
    state = sents.select("set_id", F.col("sent_idx").alias("i")).join(near, ["set_id", "i"], "left").join(own, ["set_id", "i"], "left")
    state = state.select("set_id", "i", F.coalesce("k1", F.lit(-1)).alias("k1"), F.coalesce("d1", F.lit(0.0)).alias("d1"), F.coalesce("d2", F.lit(0.0)).alias("d2"), F.coalesce("own", F.lit(False)).alias("own"))
    state = state.withColumn("none", F.lit(0.0))
    plain = state.where("not own")
    # what each candidate wins from sentences that keep their medoid, and what it gives up itself
    met = sides.join(plain.select("set_id", "i", "k1", "d1", "d2"), ["set_id", "i"])
    win = met.groupBy("set_id", "j").agg(F.sum(F.greatest(F.col("s") - F.col("d1"), F.lit(0.0))).alias("win"))
    items = plain.select("set_id", F.col("i").alias("j"), F.col("d1").alias("own_d1"), F.col("k1").alias("own_k"), F.col("d2").alias("own_d2")).join(win, ["set_id", "j"], "left")
    # what a medoid's sentences lose if it goes, and what a candidate makes good of that
    loss = plain.where("k1 >= 0").groupBy("set_id", F.col("k1").alias("k")).agg(F.sum(F.col("d2") - F.col("d1")).alias("loss"))
    good = met.where("k1 >= 0").groupBy("set_id", F.col("k1").alias("k"), "j").agg(F.sum(F.greatest("s", "d2") - F.col("d1") - F.greatest(F.col("s") - F.col("d1"), F.lit(0.0)) - (F.col("d2") - F.col("d1"))).alias("good"))
    # the medoid that goes: to the candidate or to the nearest medoid that stays, which is the first of `near` (it is not near itself)
    gone = medoids.select("set_id", "k", F.col("medoid").alias("i")).join(near.select("set_id", "i", "d1"), ["set_id", "i"], "left").select("set_id", "k", "i", F.coalesce("d1", F.lit(0.0)).alias("rest"))
    swaps = gone.join(items, "set_id").join(loss, ["set_id", "k"], "left").join(good, ["set_id", "k", "j"], "left").join(sides.select("set_id", "i", "j", "s"), ["set_id", "i", "j"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    self_loss = F.when(F.col("own_k") == F.col("k"), F.col("own_d2") - F.col("own_d1")).otherwise(0.0)  # counted in `loss`, but the candidate is no longer assigned
    gain = zero(F.col("win")) + zero(F.col("loss")) - self_loss + zero(F.col("good")) + F.greatest(zero(F.col("s")), F.col("rest")) - F.col("own_d1")
    return swaps.select("set_id", "k", F.col("j").alias("sent_idx"), gain.alias("gain"))


def pam(sents: DataFrame, pairs: DataFrame, seed: int = 7, k: Column | None = None) -> DataFrame:
    """(set_id, sent_idx, k): `kernel_pam` for all sets at once, as joins. A round makes one swap in each set, that of the first place from
    where the last one was, of its first sentence, that raises the utility; sets without one are done. Similarities are not negative."""
    pairs = pairs.checkpoint()
    medoids = seeded_medoids(sents, seed, k).checkpoint()
    sizes = medoids.groupBy("set_id").agg(F.count("*").alias("n")).checkpoint()
    cursor = sizes.select("set_id", F.lit(0).alias("at")).checkpoint()
    open_ = cursor
    while True:
        live = medoids.join(open_.select("set_id"), "set_id", "left_semi")
        gains = swap_gains(sents.join(open_.select("set_id"), "set_id", "left_semi"), live, pairs.join(open_.select("set_id"), "set_id", "left_semi"))
        turn = F.pmod(F.col("k") - F.col("at"), F.col("n"))
        first = gains.where(F.round("gain", 9) > 0).join(open_, "set_id").join(sizes, "set_id").groupBy("set_id").agg(F.min(F.struct(turn.alias("turn"), "sent_idx", "k", "n")).alias("m"))
        first = first.select("set_id", F.col("m.k").alias("k"), F.col("m.sent_idx").alias("item"), F.expr("(m.k + 1) % m.n").cast("int").alias("at")).checkpoint()
        if first.isEmpty():
            return assigned(sents, medoids, pairs)
        medoids = medoids.join(first.select("set_id", "k", "item"), ["set_id", "k"], "left").select("set_id", "k", F.coalesce("item", "medoid").alias("medoid")).checkpoint()
        open_ = first.select("set_id", "at")


def distance_medoids(sents: DataFrame, pairs: DataFrame, seed: int = 7) -> DataFrame:
    """(set_id, sent_idx, k): `kernel_distance_medoids` of distances 1 - s for all sets at once, as joins; a pair that is not there has distance 1.
    Sets whose state was met before are done; states are told apart by a hash."""
    shape = sents.groupBy("set_id").agg(F.count("*").alias("n")).withColumn("kk", k_of(F.col("n")))
    order = W.partitionBy("set_id").orderBy("sent_idx")
    # the remainder of the 128-bit hash by kk, in two halves of 64 bits and four of 32, so that nothing overflows
    h = F.md5(F.expr(f"concat('{seed}:', place)"))
    part = lambda a: F.conv(F.substring(h, a, 8), 16, 10).cast("long")
    step = lambda rest, a: F.pmod(rest * F.pmod(F.lit(1 << 32), F.col("kk")) + part(a), F.col("kk"))
    placed = sents.select("set_id", "sent_idx", (F.row_number().over(order) - 1).alias("place")).join(shape, "set_id")
    start = F.when(F.col("place") < F.col("kk"), F.col("place")).otherwise(step(step(step(F.pmod(part(1), F.col("kk")), 9), 17), 25))
    sides = both_ways(pairs).checkpoint()
    state = placed.select("set_id", "sent_idx", "place", "kk", "n", start.cast("int").alias("k")).checkpoint()
    done, seen = None, None
    print_of = lambda df: df.groupBy("set_id").agg(F.sum(F.xxhash64("place", "k").cast("decimal(38,0)")).alias("print"))
    while True:
        now = print_of(state)
        again = now.join(seen, ["set_id", "print"], "left_semi").select("set_id").checkpoint() if seen is not None else None
        if again is not None:
            ended = state.join(again, "set_id", "left_semi").select("set_id", "sent_idx", "k")
            done = ended.checkpoint() if done is None else done.union(ended).checkpoint()
            state = state.join(again, "set_id", "left_anti").checkpoint()
            if state.isEmpty():
                return done
        seen = now.checkpoint() if seen is None else seen.union(now).checkpoint()
        # a member's summed distance is the size of its cluster less its similarities there, and less 1 for itself
        c = state.select("set_id", F.col("sent_idx").alias("i"), "k")
        inside = sides.join(c, ["set_id", "i"]).join(c.select("set_id", F.col("i").alias("j"), F.col("k").alias("kj")), ["set_id", "j"]).where("k = kj").groupBy("set_id", "i").agg(F.sum("s").alias("near"))
        centre = state.join(inside.withColumnRenamed("i", "sent_idx"), ["set_id", "sent_idx"], "left").groupBy("set_id", "k").agg(F.min(F.struct(F.round(-F.coalesce("near", F.lit(0.0)), 9).alias("o"), "sent_idx")).alias("m")).select("set_id", "k", F.col("m.sent_idx").alias("j"))
        zero = state.where("place = 0").select("set_id", F.col("sent_idx").alias("first"), F.explode(F.sequence(F.lit(0), F.col("kk") - 1)).alias("k"))
        centre = zero.join(centre, ["set_id", "k"], "left").select("set_id", "k", F.coalesce("j", "first").alias("j"), F.col("j").isNull().alias("empty"))
        # nearest: distance 0 to itself, 1 - s, or 1; of equal ones the lowest cluster
        to = sides.join(centre, ["set_id", "j"]).select("set_id", F.col("i").alias("sent_idx"), F.round(1 - F.col("s"), 9).alias("d"), "k")
        to = to.union(centre.select("set_id", F.col("j").alias("sent_idx"), F.lit(0.0), "k")).union(state.select("set_id", "sent_idx", F.lit(1.0), F.lit(0)))
        best = to.groupBy("set_id", "sent_idx").agg(F.min(F.struct("d", "k")).alias("m")).select("set_id", "sent_idx", F.col("m.k").alias("k"))
        state = state.drop("k").join(best, ["set_id", "sent_idx"]).select("set_id", "sent_idx", "place", "kk", "n", "k").checkpoint()


def disagreement(clusterings: DataFrame) -> DataFrame:
    """(set_id, differ): places at which clusterings (clustering_id, set_id, sent_idx, k) differ, over ordered pairs of them.

    Counted per sentence from the sizes of its groups of equal clusters; no pair of clusterings is made.
    """
    same = clusterings.groupBy("set_id", "sent_idx", "k").agg(F.count("*").alias("c"))
    per = same.groupBy("set_id", "sent_idx").agg((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("differ"))
    return per.groupBy("set_id").agg(F.sum("differ").alias("differ"))


def members_by_similarity(clusters: DataFrame, medoids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(set_id, k, place, sent_idx, s): each cluster's members, most similar to the medoid first; the medoid itself counts 1."""
    m = clusters.join(medoids.select("set_id", "k", "medoid"), ["set_id", "k"])
    near = both_ways(pairs).select("set_id", F.col("i").alias("sent_idx"), F.col("j").alias("medoid"), "s")
    rows = m.join(near, ["set_id", "sent_idx", "medoid"], "left").withColumn("s", F.when(F.col("sent_idx") == F.col("medoid"), 1.0).otherwise(F.coalesce("s", F.lit(0.0))))
    order = W.partitionBy("set_id", "k").orderBy(F.round("s", 9).desc(), "sent_idx")
    return rows.select("set_id", "k", F.row_number().over(order).alias("place"), "sent_idx", "s")
