import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest

from abridge.llm import ngram_jaccard
from abridge.llm.common import connected_components
from abridge.llm.embedding_dedup import near_duplicate_vectors
from abridge.llm.ngram_jaccard import jaccard_components, without_ids


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _set(text, n=5):
    w = _words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def _brute(rows):
    low = {i: i for i, _ in rows}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for (i, a), (j, b) in itertools.combinations([(i, _set(t)) for i, t in rows], 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((find(i), find(j)))
            low[y] = x
    return {i: (len(_set(t)), find(i)) for i, t in rows}


def _corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(60)]
    base = [[word() for _ in range(rng.randint(1, 120))] for _ in range(12)]
    texts = [None, "", "  \n", "one", "ONE", "one two", "x " * 400]
    for b in base:
        for _ in range(rng.randint(1, 14)):  # groups longer than the short lists
            c = list(b)
            for _ in range(rng.randint(0, 4)):
                c[rng.randrange(len(c))] = word()
            texts.append(" ".join(c))
        texts.append(" ".join(b + passage))
    return list(enumerate(texts + texts[-3:]))


@pytest.mark.parametrize("seed, hot", [(1, 64), (2, 5)])
def test_components_are_the_brute_ones(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(ngram_jaccard, "HOT_LEAST", hot)
    rows = _corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, a int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == _brute(rows)


def _descendants(seed):
    """Copies of copies: families whose members link with others than the original, deletions, and a passage that all share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(3))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(3):
        line = [[word() for _ in range(rng.randint(40, 90))]]
        for _ in range(30):
            c = list(rng.choice(line))
            for _ in range(rng.randint(0, 6)):
                k = rng.randrange(len(c))
                c[k : k + rng.choice([1, 1, 4])] = [word()] * rng.choice([0, 1, 1])
            line.append(c)
            texts.append(" ".join(c))
        texts += [" ".join(passage + line[0][k : k + rng.randint(3, 12)]) for k in range(0, 40, 5)]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, family", [(3, 1_000_000), (4, 0)])
def test_families_of_copies_of_copies(spark, monkeypatch, seed, family):
    monkeypatch.setattr(ngram_jaccard, "HOT_LEAST", 12)
    monkeypatch.setattr(ngram_jaccard, "FAMILY", family)  # small ones in a task, or rows of a large one
    rows = _descendants(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, short=2).collect()}
    want = _brute(rows)
    assert got == want and 5 < len({c for _, c in want.values()}) < len(rows) - 20


def test_jaccard_edges(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = jaccard_components(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in rows) == [(0, 2, 0), (2, 2, 2), (2, 2, 2), (3, 2, 2)]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_without_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "doc_id long, text string")
    assert sorted(r.text for r in without_ids(docs, spark.createDataFrame([(2,), (9,)], "doc_id long"), "doc_id").collect()) == ["a", "d"]


def _links(rows, t):
    ok = [(i, np.array(v, float), y) for i, v, y in rows if i is not None and y is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    return {(i, j) for (i, a, x), (j, b, y) in itertools.permutations(ok, 2) if x == y and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= t}


@pytest.mark.parametrize("cells", [1, 3, 50])
def test_vectors_against_brute_force(spark, cells):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(12):
        centre = rng.normal(size=4)
        rows += [(len(rows) + k, (centre + rng.normal(scale=0.1, size=4)).tolist(), int(rng.integers(0, 2))) for k in range(9)]
    n = len(rows)
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, rows[0][1], rows[0][2]), (n + 2, None, 0), (n + 3, [0.0] * 4, 0), (n + 4, [1.0, None, 0.0, 0.0], 0), (n + 5, [float("nan"), 1.0, 1.0, 1.0], 0), (n + 6, [1.0, 2.0], 0), (n + 7, rows[0][1], None), (n + 8, [], 0), (n + 9, [2.0, 4.0], 0), (n + 10, [-1.0, 2.0], 0), (n + 11, [1.0, 0.0, 0.0, 0.0, 0.0], 1), (n + 12, [1.0, -0.0, 0.0, 0.0, 0.1], 1), (n + 13, [3.0, -0.0, 0.0, 0.0, 0.0], 1), (n + 14, [1.0, 0.0, 0.0, -0.0, 0.0], 1)]
    docs = spark.createDataFrame([(i, v, y, "c") for i, v, y in rows], "vec_id long, embedding array<double>, label int, rep string")
    got = near_duplicate_vectors(docs, 0.98, cells=cells, sample=60).toPandas().set_index("vec_id")
    links = _links(rows, 0.98)
    many = pd.Series([i for i, _ in links]).value_counts()
    assert {i: int(many.get(i, 0)) for i, _, _ in rows} == got["n_links"].to_dict()
    low = {i: i for i, _, _ in rows}
    for _ in range(len(rows)):
        for i, j in links:
            low[i] = min(low[i], low[j])
    assert low == got["component_id"].to_dict()
    assert (got["kept"] == (got.index == got["component_id"])).all()


def test_no_vectors(spark):
    assert near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_a_bucket_of_the_index_is_a_tasks_own(spark, monkeypatch):
    plans = {}

    def kept(df, name="part"):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    real = ngram_jaccard.kept
    monkeypatch.setattr(ngram_jaccard, "kept", kept)
    rows = [(k, " ".join(f"w{(k % 7) * 50 + j}" for j in range(40)) + f" x{k}") for k in range(60)]
    found = {(r.doc_id, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(k, k % 7) for k in range(60)}
    by = next(line for line in plans["lists"].splitlines() if "RepartitionByExpression" in line)
    assert "directshufflepartitionid" in by.lower().replace("_", ""), by
