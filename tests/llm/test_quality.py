import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from abridge.llm import quality
from abridge.llm.quality_query import op11_quality

SF = "/root/testdata/sf0.01"


def _plain(text: str) -> np.ndarray:
    """The counts, sign by sign."""
    data, out = text.encode(), np.zeros(quality.SUMS)
    for a, b in zip(data, data[1:]):
        out[int(quality._KIND[a]) * quality.KINDS + int(quality._KIND[b])] += 1
    lines, words = [], []
    for line in text.replace("\r", "\n").split("\n"):
        own = line.lower().split(" ")
        own = [w for w in own if w]
        words += own
        if own:
            lines.append(tuple(own))
    n = quality.PAIRS
    out[n], out[n + 1] = len(data), len(words)
    out[n + 2] = sum(a == b for a, b in zip(words, words[1:]))
    out[n + 3] = sum(a == b for a, b in zip(words, words[2:]))
    out[n + 4], out[n + 5], out[n + 6] = len(lines), len(lines) - len(set(lines)), len(set(words))
    return out


def test_counts_against_a_plain_run():
    texts = ["", " ", "one", "One one ONE two\nthree\n\nthree\nthree four", "a b a b\r\na b a b", "é ü, é! {x} | 1+1", "\n", "x\n", "x y\n x  y\n"]
    got = quality.sums_of(pa.array(texts, pa.large_string()))
    assert np.array_equal(got, np.array([_plain(t) for t in texts]))


def test_a_giant_text_is_read_in_windows(monkeypatch):
    monkeypatch.setattr(quality, "WINDOW", 64)
    text = pa.array([" ".join(f"word{k}" for k in range(500)), "short one."], pa.large_string())
    parts = list(quality._windows(text.slice(0, 1)))
    assert b"".join(p[0].as_py().encode() for p in parts) == text[0].as_py().encode() and len(parts) > 20
    sums = sum(map(quality.sums_of, parts))[0]
    assert sums[quality.PAIRS] == len(text[0].as_py()) and sums[quality.PAIRS + 1] == 500
    assert quality.described(text).shape == (2, quality.PAIRS + 7)


def test_slopes_are_those_of_differences():
    rng = np.random.default_rng(0)
    net = quality.QualityNet(np.zeros(4), np.ones(4), [rng.normal(size=(4, 3)), rng.normal(size=3), rng.normal(size=3), np.array(0.2), rng.normal(size=4)])
    z = rng.normal(size=(6, 4))
    hidden, f = net._forward(z)
    got = net.slopes(z, hidden, quality._sigmoid(f) - 1)
    risk = lambda: np.logaddexp(0, -net._forward(z)[1]).sum()
    for k, w in enumerate(net.w):
        for at in np.ndindex(w.shape):
            kept, small = w[at], 1e-6
            w[at] = kept + small
            up = risk()
            w[at] = kept - small
            down = risk()
            w[at] = kept
            assert abs((up - down) / (2 * small) - got[k][at]) < 1e-4


def test_prior_and_risk_on_two_clouds():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8):
        good = rng.normal(2, 1, (1500, 3))
        n = int(3000 * share)
        unlabelled, truth = np.concatenate([rng.normal(2, 1, (n, 3)), rng.normal(-1, 1, (3000 - n, 3))]), np.arange(3000) < n
        order = rng.permutation(3000)
        net = quality.fit(good, unlabelled[order])
        assert abs(net.prior - share) < 0.08
        assert ((net.scores(unlabelled[order]) >= 0.5) == truth[order]).mean() > 0.96


def test_held_out_labels(spark):
    rows = op11_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    everything = op11_quality(spark, SF)
    assert everything.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_labels_of_the_other_fold_and_of_bad_texts_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(300).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a = quality.learn_quality(docs, labels)
    b = quality.learn_quality(docs, labels.where("quality = 1"))
    assert all(np.array_equal(x, y) for x, y in zip(a.w, b.w)) and a.prior == b.prior


def test_nulls_empty_repeated_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(200)
    net = quality.learn_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    odd = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (1, None, "x"), (2, "Ab. " * 90000, "z")], "doc_id long, text string, score string").withColumn("predicted", F.lit("p"))
    got = quality.score_quality(odd, net).collect()
    assert len(got) == 4 and got[0].score == got[1].score == got[2].score and set(got[0].asDict()) == {"doc_id", "text", "score", "predicted"}
    assert quality.score_quality(odd.limit(0), net).collect() == []
    none = quality.learn_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert none is None and {r.score for r in quality.score_quality(odd, none).collect()} == {0.0}
