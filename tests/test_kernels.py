"""Queries of round 3's findings that work on one row, or one chunk of sets, at a time: the same results as by joins."""

from dataclasses import replace

from pyspark.sql import functions as F

from abridge.api import choose, tfidf_weights
from abridge.config import Config
from abridge.functions import text as T
from abridge.operators import cluster, measures, select, terms
from abridge.operators import vectors as V
from abridge.sources.lists import Lists

WORDS = ("red", "fox", "bird", "runs", "sleeps", "far", "away", "blue", "song", "the", "old", "sea")
TEXTS = [(s, ". ".join(" ".join(WORDS[(s * 7 + i * i * 3 + j * (i + s + 2)) % len(WORDS)] for j in range(4 + (i + s) % 5)) for i in range(n)) + ".") for s, n in enumerate((1, 2, 9, 14, 23, 23))]
TEXTS += [(6, None), (7, ""), (8, "The the the the. Red fox runs far. Red fox runs far. Blue bird sings song."), (9, "The the the the.")]
STOP = ("the",)
PLAIN = Config(bigrams=False)


def _docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def _rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def _units(spark):
    return V.unit_vectors(tfidf_weights(T.sentences(_docs(spark)), PLAIN, lists=Lists(stop=STOP)))


def test_lloyd_of_rows(spark):
    for rounds in (0, 2, None):
        new = V.document_lloyd(_docs(spark), PLAIN, STOP, rounds)
        assert _rows(new) == _rows(V.lloyd(_units(spark), rounds=rounds))
        assert _exchanges(new) == 0


def test_bisection_of_rows(spark):
    for levels in (0, 2, None):
        new = V.document_bisection(_docs(spark), PLAIN, STOP, levels=levels)
        assert _rows(new) == _rows(V.repeated_bisection(_units(spark), levels=levels))
        assert _exchanges(new) == 0


def test_medoids_of_rows(spark):
    select.shared_checkpoints(spark)
    s = T.sentences(_docs(spark))
    new = select.document_medoids(_docs(spark), Config(), STOP)
    assert _rows(new) == _rows(cluster.kmedoids(s, select.cosine_pairs(_docs(spark), Config(), STOP)))
    assert _exchanges(new) == 0


def test_members_of_rows(spark):
    s, cos = T.sentences(_docs(spark)), select.cosine_pairs(_docs(spark), Config(), STOP)
    medoids = cluster.seeded_medoids(s)
    new = select.document_members(_docs(spark), Config(), STOP)
    assert _rows(new) == _rows(cluster.members_by_similarity(cluster.assigned(s, medoids, cos), medoids, cos))
    assert _exchanges(new) == 0


def test_pairs_of_an_index_of_rows(spark, monkeypatch):
    old = measures.indexed_cosine(terms.document_weights(_docs(spark), STOP, True))
    for most in (select.PLACED, 3):
        monkeypatch.setattr(select, "PLACED", most)
        new = select.indexed_pairs(_docs(spark), Config(), STOP)
        assert _rows(new) == _rows(old) and new.count() > 0
        assert _exchanges(new) == 0


def test_choice_of_rows(spark):
    s, cos = T.sentences(_docs(spark)), select.cosine_pairs(_docs(spark), Config(), STOP)
    new = select.document_greedy(_docs(spark), Config(), 3, STOP)
    old = select.greedy(select.with_diagonal(cos, s), s, cluster.assigned(s, cluster.seeded_medoids(s), cos), 3)
    assert _rows(new) == _rows(old.withColumn("score", F.round("score", 9)))
    assert _exchanges(new) == 0


def test_shared_words_of_sets(spark):
    s = T.sentences(_docs(spark))
    words = s.select("set_id", F.col("sent_idx").alias("i"), F.explode(F.array_distinct("words")).alias("w"))
    medoids = cluster.seeded_medoids(s)
    of = words.join(medoids.select("set_id", F.col("medoid").alias("i"), "k"), ["set_id", "i"]).select("set_id", "w", F.col("i").alias("j"))
    pairs = words.join(of, ["set_id", "w"]).where("i <> j").groupBy("set_id", "i", "j").agg(F.count("*").cast("double").alias("s"))
    new = cluster.by_shared_words(s)
    assert _rows(new) == _rows(cluster.assigned(s, medoids, pairs))
    assert "Join" not in new._jdf.queryExecution().optimizedPlan().toString()


def test_summary_of_rows_by_all_measures(spark):
    config = Config(length=9, use_sentiment=True, stemmer="porter2")
    lists = Lists(stop=("the", "runs"), positive=("red", "song"), negative=("far", "old", "red"))
    s = T.sentences(_docs(spark))
    features = measures.sentiment_fractions(s, lists.positive, lists.negative).withColumn("vec", F.lit(None).cast("array<double>"))
    for more in ({}, {"clusterings": "each", "aggregate": "max"}, {"pronouns": ("sea",), "prune": 0.4, "cluster_on_aggregate": True}):
        c = replace(config, **more)
        near = not c.cluster_on_aggregate and c.clusterings == "one"
        new = choose(_docs(spark), c, lists=lists)[0]
        old = select.select_by_features(tfidf_weights(s, c, lists=lists), features, s, c, ("pos", "neg", "tfidf"), near)
        assert _rows(new) == _rows(old) and new.count() > 0
        assert "MapInArrow" in (plan := new._jdf.queryExecution().optimizedPlan().toString()) and "FlatMapGroups" not in plan
