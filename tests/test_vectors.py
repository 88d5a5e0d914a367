import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from abridge.operators import vectors as V


def _table(spark, sets=5, seed=1):
    rng, rows, dense = random.Random(seed), [], {}
    for s in range(sets):
        n = rng.randrange(1, 14)
        x = np.array([[rng.choice([0, 0, 1, 2]) + (t == k % 7) for t in range(7)] for k in range(n)], float)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        dense[s] = x
        rows += [(s, k, f"t{t}", float(x[k, t])) for k in range(n) for t in range(7) if x[k, t]]
    return spark.createDataFrame(rows, "set_id long, i int, term string, w double"), dense


def _lloyd(x):
    n = len(x)
    k = max(1, int(0.2 * n + 0.5))
    order = sorted(range(n), key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())[:k]

    def assign(c):
        d = np.round(1 + (c * c).sum(1) - 2 * x @ c.T, 9)
        out, cost = d.argmin(1), d.min(1).copy()
        empty = [q for q in range(k) if q not in out]
        for q, i in zip(empty, sorted(range(n), key=lambda i: (-cost[i], i))[: len(empty)]):
            if cost[i] > 0:
                out[i], cost[i] = q, 0
        return out, cost

    out, cost = assign(x[order])
    while True:
        c = np.array([x[out == q].mean(0) if (out == q).any() else np.full(x.shape[1], 9.0) for q in range(k)])
        again, now = assign(c)
        if round(now.sum(), 9) >= round(cost.sum(), 9):
            return out
        out, cost = again, now


def test_lloyd_against_numpy(spark):
    table, dense = _table(spark, sets=4, seed=2)
    got = {(r.set_id, r.i): r.k for r in V.lloyd(table).collect()}
    for s, x in dense.items():
        assert [got[s, i] for i in range(len(x))] == _lloyd(x).tolist()


def test_bisection_makes_k_clusters_and_never_lengthens_less(spark):
    table, dense = _table(spark, sets=3, seed=4)
    most, before = F.lit(3), None
    for levels in (0, 1, 2, None):
        clusters = V.repeated_bisection(table, most, levels=levels)
        rows = clusters.collect()
        found = {s: {r.k for r in rows if r.set_id == s} for s in dense}
        assert all(f == set(range(len(f))) and len(f) <= min(3, len(dense[s]), 1 + (3 if levels is None else levels)) for s, f in found.items())
        total = {r.set_id: r.total for r in V.composite_length(table, clusters).collect()}
        for s, x in dense.items():
            assert abs(total[s] - sum(np.sqrt((x[[r.i for r in rows if r.set_id == s and r.k == k]].sum(0) ** 2).sum()) for k in found[s])) < 1e-9
        assert before is None or all(total[s] >= before[s] - 1e-12 for s in total)
        before = total
