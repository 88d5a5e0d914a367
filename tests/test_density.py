import random

import pytest

from abridge.operators.density import components, density_best, density_clusters, density_sweep


def _plain(n, s, eps, least):
    near = lambda i, j: s.get((min(i, j), max(i, j)), 0.0) >= round(1 - eps, 9)
    core = [i for i in range(n) if 1 + sum(near(i, j) for j in range(n) if j != i) >= least]
    label, k = {}, 0
    for i in core:
        if i in label:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if label.setdefault(x, k) == k:
                todo += [y for y in core if y != x and near(x, y) and y not in label]
        k += 1
    out = []
    for i in range(n):
        reach = [(-s[min(i, j), max(i, j)], j) for j in core if j != i and near(i, j)]
        out.append(label[i] if i in label else label[min(reach)[1]] if reach else -1)
    return out, k


@pytest.fixture(scope="module")
def table(spark):
    rng, pairs, sents, want = random.Random(3), [], [], {}
    for t in range(4):
        n = 6 + 5 * t
        s = {(i, j): round(rng.random() ** (1 if (i // 4) == (j // 4) else 4), 2) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.7}
        want[t] = (n, s)
        pairs += [(t, i, j, v) for (i, j), v in s.items()]
        sents += [(t, i) for i in range(n)]
    sents += [(9, 0)]
    return spark.createDataFrame(sents, "set_id long, sent_idx int"), spark.createDataFrame(pairs, "set_id long, i int, j int, s double"), want | {9: (1, {})}


@pytest.mark.parametrize("eps, least", [(0.2, 3), (0.5, 2), (0.4, 4), (0.3, 1)])
def test_clusters_against_brute_force(table, eps, least):
    sents, pairs, want = table
    got = {(r.set_id, r.sent_idx): r.k for r in density_clusters(sents, pairs, eps, least).collect()}
    assert got == {(t, i): k for t, (n, s) in want.items() for i, k in enumerate(_plain(n, s, eps, least)[0])}


def test_a_sweep_finds_what_single_runs_find(table):
    sents, pairs, want = table
    counts, _ = density_sweep(sents, pairs, [0.1, 0.25, 0.4, 0.6], [2, 3])
    got = {(r.set_id, r.least, r.eps): r.clusters for r in counts.collect()}
    assert got == {(t, m, e): _plain(n, s, e, m)[1] for t, (n, s) in want.items() for m in (2, 3) for e in (0.1, 0.25, 0.4, 0.6)}


def test_the_best_of_a_sweep(table):
    sents, pairs, want = table
    distances, least = [0.1, 0.25, 0.4, 0.6], [2, 3]
    rows = density_best(sents, pairs, distances, least).collect()
    assert len(rows) == sents.count()
    for t, (n, s) in want.items():
        mine = [r for r in rows if r.set_id == t]
        k = max(1, int(0.2 * n + 0.5))
        assert len({(r.eps, r.least) for r in mine}) == 1
        found = _plain(n, s, mine[0].eps, mine[0].least)
        assert [r.k for r in sorted(mine, key=lambda r: r.sent_idx)] == found[0]
        assert abs(found[1] - k) == min(abs(_plain(n, s, e, m)[1] - k) for e in distances for m in least)


def test_components_within_keys(spark):
    links = spark.createDataFrame([("a", i, i + 1) for i in range(40)] + [("b", 3, 9), ("b", 9, 1), ("b", 5, 5)], "g string, a int, b int")
    got = {(r.g, r.node): r.root for r in components(links, ["g"]).collect()}
    assert got == {("a", i): 0 for i in range(41)} | {("b", i): 1 for i in (1, 3, 9)}
    assert components(links.limit(0), ["g"]).collect() == []
