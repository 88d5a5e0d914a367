import numpy as np
import pytest

from abridge.config import Config
from abridge.operators import cluster, combine, select

W = np.array([[1, 0.6, 0.1, 0, 0, 0.2], [0.6, 1, 0.3, 0, 0, 0.1], [0.1, 0.3, 1, 0.4, 0, 0], [0, 0, 0.4, 1, 0.5, 0.2], [0, 0, 0, 0.5, 1, 0.3], [0.2, 0.1, 0, 0.2, 0.3, 1]])
K = np.array([0, 0, 0, 1, 1, 1])


def _frames(spark):
    pairs = spark.createDataFrame([(1, i, j, float(W[i, j])) for i in range(6) for j in range(i + 1, 6) if W[i, j]], "set_id long, i int, j int, s double")
    sents = spark.createDataFrame([(1, i) for i in range(6)], "set_id long, sent_idx int")
    return pairs, sents, spark.createDataFrame([(1, i, int(k)) for i, k in enumerate(K)], "set_id long, sent_idx int, k int")


def test_greedy_kernel():
    found = select.kernel_select(W, K, np.ones(6), np.ones(6), Config(length=4, unit="SENTENCES", singleton=False))
    assert [i for i, _ in found] == [3, 1, 0, 4]
    assert [round(s, 6) for _, s in found] == [5.649648, 11.113749, 14.370336, 17.458043]


def test_greedy_relational_is_the_kernel(spark):
    pairs, sents, clusters = _frames(spark)
    rows = select.greedy(select.with_diagonal(pairs, sents), sents, clusters, 4).orderBy("step").collect()
    assert [r.sent_idx for r in rows] == [3, 1, 0, 4]
    assert round(rows[-1].score, 6) == 17.458043


@pytest.mark.parametrize("chosen, cover, spread, several", [([0], 1.9, 0.562731, 0.316667), ([1, 3], 4.1, 1.168958, 1.168958), ([1, 2], 3.8, 0.795822, 0.795822)])
def test_objective(spark, chosen, cover, spread, several):
    pairs, sents, clusters = _frames(spark)
    full = select.with_diagonal(pairs, sents)
    deg = select.degrees(full, sents)
    s = spark.createDataFrame([(1, i) for i in chosen], "set_id long, sent_idx int")
    assert select.coverage_score(s, full, deg).first().coverage == pytest.approx(cover, abs=1e-6)
    assert select.diversity_score(s, clusters, deg).first().diversity == pytest.approx(spread, abs=1e-6)
    kinds = clusters.selectExpr("0 as clustering_id", "set_id", "sent_idx", "k")
    assert select.diversity_of_several(s, kinds, deg).first().diversity == pytest.approx(several, abs=1e-6)


def test_budgets():
    costs = np.array([5.0, 50, 5, 5, 5, 5])
    strict = select.kernel_select(W, K, costs, costs, Config(length=20, singleton=False, strict_length=True))
    assert sum(costs[i] for i, _ in strict) <= 20
    assert select.kernel_select(W, K, costs, costs, Config(length=0)) == []
    assert len(select.kernel_select(W, K, costs, costs, Config(length=10**6, singleton=False))) == 6


def test_kmedoids_kernel_is_the_relational_round(spark):
    pairs, sents, _ = _frames(spark)
    medoids = cluster.seeded_medoids(sents)
    rows = cluster.assigned(sents, medoids, pairs).orderBy("sent_idx").collect()
    off = W - np.eye(6)
    first = cluster.kernel_assign(off, cluster.seeded_order(6, 7)[: medoids.count()])
    assert [r.k for r in rows] == first.tolist()


def test_aggregates(spark):
    a = spark.createDataFrame([(1, 0, 1, 0.5), (1, 0, 2, 1.0)], "set_id long, i int, j int, s double")
    b = spark.createDataFrame([(1, 0, 1, 0.2), (1, 0, 2, 0.0)], "set_id long, i int, j int, s double")
    stack = combine.stacked([a, b])
    got = {(r.i, r.j): round(r.s, 6) for r in combine.lp_norm(stack, 2).collect()}
    assert got == {(0, 1): 0.538516, (0, 2): 1.0}
    assert {round(r.s, 6) for r in combine.product(stack, 2).collect()} == {0.0, 1.0}
    same = combine.product(combine.stacked([b.selectExpr("set_id", "i", "j", "0.0D as s"), a]), 2)
    assert {r.s for r in same.collect()} == {1.0}  # a constant product is neutral, not NaN
