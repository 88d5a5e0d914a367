"""Clustering variants, digest, files, predicates, streaming: small operators against values by hand."""

from collections import Counter

import datetime
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from abridge import api
from abridge.config import Config
from abridge.functions import text as T
from abridge.functions.stem2 import porter2, porter2_stems
from abridge.operators import cluster, combine, digest, measures, render, select, terms
from abridge.plans.words import STOP
from abridge.sources import readers, writers
from abridge.streaming.summaries import summarize_stream
from tests.test_select import W, _frames

TEXT = "Cats chase small mice daily. Cats chase small birds daily. Rain fell on the town today. The town saw heavy rain today. Mice fear all cats here."


def test_partitioning_around_medoids():
    """One medoid is the best there is, more are no worse than those it begins with; two clusters of distances by hand."""
    off = W - np.eye(6)

    def worth(medoids):
        return off[:, medoids].max(axis=1)[[i for i in range(6) if i not in medoids]].sum()

    for k in (1, 2, 3):
        best = max(worth([m]) for m in range(6)) if k == 1 else worth(cluster.seeded_order(6, 7)[:k])
        out = cluster.kernel_pam(W, k)
        assert len(set(out)) == k
        got = sum(max(off[np.ix_(rows, rows)].sum(axis=0)) for rows in (np.flatnonzero(out == c) for c in range(k)))
        assert got >= best - 1e-9
    d = np.abs(np.subtract.outer([0, 1, 2, 10, 11, 13], [0, 1, 2, 10, 11, 13])).astype(float)
    out = cluster.kernel_distance_medoids(d, 2)
    assert len(set(out[:3])) == 1 and len(set(out[3:])) == 1 and out[0] != out[3]


def test_kmedoids_by_joins_is_the_kernel(spark):
    rng = np.random.default_rng(3)
    for n in (1, 4, 17):
        w = np.round(rng.random((n, n)) * (rng.random((n, n)) < 0.6), 3)
        w = np.triu(w, 1) + np.triu(w, 1).T + np.eye(n)
        select.shared_checkpoints(spark)
        pairs = spark.createDataFrame([(1, i, j, float(w[i, j])) for i in range(n) for j in range(i + 1, n) if w[i, j]], "set_id long, i int, j int, s double")
        sents = spark.createDataFrame([(1, i) for i in range(n)], "set_id long, sent_idx int")
        assert [r.k for r in cluster.kmedoids(sents, pairs).orderBy("sent_idx").collect()] == cluster.kernel_medoids(w).tolist()


def test_disagreement_and_members(spark):
    pairs, sents, clusters = _frames(spark)
    both = clusters.selectExpr("0 as clustering_id", "*").union(sents.selectExpr("1 as clustering_id", "set_id", "sent_idx", "0 as k"))
    assert cluster.disagreement(both).first().differ == 6  # three places, both orders
    medoids = spark.createDataFrame([(1, 0, 1), (1, 1, 3)], "set_id long, k int, medoid int")
    rows = cluster.members_by_similarity(clusters, medoids, pairs).orderBy("k", "place").collect()
    assert [(r.sent_idx, r.s) for r in rows] == [(1, 1.0), (0, 0.6), (2, 0.3), (3, 1.0), (4, 0.5), (5, 0.2)]


@pytest.mark.parametrize("clustering", ["medoids", "pam", "distances"])
def test_clustering_is_a_choice(spark, clustering):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    assert api.choose(docs, Config(length=2, unit="SENTENCES", clustering=clustering, singleton=False))[0].count() == 2
    with pytest.raises(ValueError):
        Config(clustering="other")


def test_one_pass_is_the_long_way(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, TEXT + " The the the the."), (3, None)], "doc_id long, text string")
    sents = T.sentences(docs)
    for config in (Config(length=12), Config(length=60, unit="CHARACTERS", counting="pieces"), Config(length=9, counting="pieces", idf_mode="floor", zero_idf_as_one=True, bigrams=False)):
        rows = lambda df: sorted((r.set_id, r.step, r.sent_idx, round(r.score, 6)) for r in df.collect())
        assert rows(select.select_documents(docs, config, STOP)) == rows(select.select_by_kernel(api.tfidf_weights(sents, config, lists=api.Lists(stop=STOP)), sents, config))
    w = api.tfidf_weights(sents, Config(), lists=api.Lists(stop=STOP))
    rows = lambda df: sorted((r.set_id, r.i, r.j, round(r.s, 9)) for r in df.collect())
    assert rows(select.cosine_pairs(docs, Config(), STOP)) == rows(measures.tfidf_cosine(w, terms.norms(w)))


def test_titles_overlap_by_stems(spark):
    sents = spark.createDataFrame([(1, 0, ["cats", "chase", "mice"]), (1, 1, ["cat", "chased"]), (1, 2, ["rain"])], "set_id long, sent_idx int, words array<string>")
    rows = lambda **more: [(r.i, r.j, r.s) for r in measures.title_overlap(sents, **more).collect()]
    assert rows() == [] and rows(stemmer="porter") == [(0, 1, 1.0)]


def test_idfs_of_sentences_or_of_documents(spark):
    docs = spark.createDataFrame([("s", 0, "Cats chase small mice daily. Cats sleep all night long."), ("s", 1, "Rain fell on the town today.")], "set_id string, n int, text string")
    sents = T.sentences(docs, "set_id", order_col="n")
    idf = lambda unit: {r.term: round(r.idf, 4) for r in api.tfidf_weights(sents, Config(bigrams=False, idf_unit=unit), several=True).collect()}
    assert idf("documents")["cats"] == round(np.log10(2), 4) and idf("sentences")["cats"] == round(np.log10(1.5), 4) and idf("sentences")["rain"] == round(np.log10(3), 4)


def test_terms_are_counted_in_place(spark):
    docs = spark.createDataFrame([(1, "a b a c " * 9 + ". One more sentence here is a a.")], "doc_id long, text string")
    words = [w for w in ("a b a c " * 9).split()], ["one", "more", "sentence", "here", "is", "a", "a"]
    want = sorted((1, k, t, n) for k, ws in enumerate(words) for t, n in Counter([w for w in ws if w != "c"] + [f"{x} {y}" for x, y in zip(ws, ws[1:])]).items())
    assert sorted(map(tuple, terms.bag(T.sentences(docs), ("c",), bigrams=True).collect())) == want


def test_files_for_clustering(spark, tmp_path):
    pairs, sents, clusters = _frames(spark)
    writers.save_clustering(clusters, str(tmp_path / "k"))
    again = readers.clustering_file(spark, str(tmp_path / "k/set_id=1"))
    assert [(r.sent_idx, r.k) for r in again.orderBy("sent_idx").collect()] == [(i, int(i > 2)) for i in range(6)]
    writers.save_dense_graph(select.with_diagonal(pairs, sents), str(tmp_path / "g"))
    assert spark.read.text(str(tmp_path / "g/set_id=1")).first().value == "6"
    full = select.with_diagonal(pairs, sents).union(spark.createDataFrame([(1, i, j, 0.0) for i in range(6) for j in range(6) if not W[i, j]], "set_id long, i int, j int, s double"))
    writers.save_matrix(full, str(tmp_path / "m"))
    back = {(r.i, r.j): r.s for r in readers.similarity_matrix(spark, str(tmp_path / "m/set_id=1")).collect()}
    assert back == {(i, j): float(W[i, j]) for i in range(6) for j in range(6)}


def test_documents_for_idfs(spark, tmp_path):
    (tmp_path / "corpus/one").mkdir(parents=True)
    (tmp_path / "corpus/one/sentences").write_text("cats sleep")
    (tmp_path / "a.txt").write_text("x y")
    assert [r.text for r in readers.corpus_folders(spark, str(tmp_path / "corpus")).collect()] == ["cats sleep"]
    assert [r.text for r in readers.idf_documents(spark, None, str(tmp_path / "a.txt")).collect()] == ["x y"] and readers.idf_documents(spark, None) is None
    sents = T.sentences(spark.createDataFrame([(1, TEXT)], "doc_id long, text string"))
    assert readers.idf_documents(spark, sents).count() == 5


def test_digest(spark):
    now = datetime.datetime(2020, 1, 2, 12)
    rows = spark.createDataFrame([(1, now, "http://a.b/nyheter", "T", "P", None, "x/default.png"), (2, now - datetime.timedelta(days=2), "http://a.b/nyheter", "T", None, "B", "x/y.png"), (3, now, "http://a.b/other", "T", "", "B", None)], "id long, ts timestamp, uri string, title string, preamble string, body string, image string")
    assert [r.id for r in digest.recent(rows, "ts", "2020-01-02 12:00:00", 1, "uri", "nyheter").collect()] == [1]
    assert [r.content for r in digest.content(rows).orderBy("id").collect()] == ["T P", "T B", "T  B"]
    assert [r.id for r in digest.pictures(rows).collect()] == [2]
    page = digest.html_page(spark.createDataFrame([(1, "a\n\nb\nc", ["u.png"], ["h"])], "set_id long, summary string, images array<string>, sources array<string>"), "News").first().html
    assert page == '<h1>News 1</h1>\n<img src="u.png" />\n<p>a<br /><br />\nb<br /><br />\nc</p>\n<p>h</p>\n'
    words = spark.createDataFrame([(1, "dog"), (1, "dog"), (1, "run"), (2, "dog")], "doc_id long, term string")
    assert sorted(map(tuple, digest.noun_counts(words, spark.createDataFrame([("dog",)], "term string")).collect())) == [(1, "dog", 2), (2, "dog", 1)]


def test_predicates(spark):
    row = spark.createDataFrame([("Ärlig", "Smith", "they,", "!", "fÃ¶r")], "a string, b string, c string, d string, e string").select(
        T.is_title(F.col("b")), T.is_title(F.col("c")), T.is_plural(F.col("c")), T.is_punctuation(F.col("d")), T.is_punctuation(F.col("b")), T.repaired(F.col("e"))
    ).first()
    assert tuple(row) == (True, False, True, True, False, "för")


@pytest.mark.parametrize("word, stem", [("consistency", "consist"), ("knackeries", "knackeri"), ("generously", "generous"), ("skies", "sky"), ("agreed", "agre"), ("hopping", "hop"), ("by", "by"), ("relational", "relat")])
def test_porter2(spark, word, stem):
    assert porter2(word) == stem


def test_stems_of_a_table(spark):
    rows = porter2_stems(spark.createDataFrame([("cats",), (None,)], "word string")).collect()
    assert {(r.word, r.stem) for r in rows} == {("cats", "cat"), (None, None)}


def test_word_vectors(spark):
    vectors = spark.createDataFrame([("run", [1.0, 0.0]), ("cat", [0.0, 1.0])], "word string, vec array<double>")
    words = spark.createDataFrame([("running",), ("cat",), ("none",)], "word string")
    found = measures.vectors_of_words(words, vectors, porter2_stems(words))
    assert {r.word: r.vec for r in found.collect()} == {"running": [1.0, 0.0], "cat": [0.0, 1.0]}
    tagged = spark.createDataFrame([(1, 0, "cat", "NN"), (1, 0, "run", "VB"), (1, 1, "cat", "NN"), (1, 1, "run", "NN")], "set_id long, sent_idx int, word string, tag string")
    rows = measures.tagged_word_pairs(tagged, vectors).collect()
    assert sorted((r.a, r.b, r.s) for r in rows) == [("cat", "cat", 1.0), ("cat", "run", 0.5)] and measures.nouns(tagged).count() == 3


def test_pair_values(spark):
    pairs, _, _ = _frames(spark)
    assert {r.d for r in measures.dissimilarity(pairs.where("i = 0 and j = 1")).collect()} == {0.4}
    row = measures.extreme_pairs(pairs).first()
    assert (row.low, row.low_i, row.low_j, row.high, row.high_i, row.high_j) == (0.1, 0, 2, 0.6, 0, 1)
    stack = combine.stacked([pairs, pairs])
    weights = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0)], "step int, matrix_id int, w double")
    assert {(r.i, r.j): round(r.s, 9) for r in combine.weighted_average(stack, weights, 2).collect()} == {(r.i, r.j): r.s for r in pairs.collect()}


def test_running_length_and_orders(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    chosen, sents = api.choose(docs, Config(length=3, unit="SENTENCES", singleton=False))
    rows = render.running_length(chosen, sents).orderBy("step").collect()
    sizes = {r.sent_idx: len(r.tokens) for r in sents.collect()}
    assert [r.words_so_far for r in rows] == np.cumsum([sizes[r.sent_idx] for r in rows]).tolist()
    by_step = render.summary_text(chosen, sents, "step").first().summary.split("\n")
    assert sorted(by_step) == sorted(render.summary_text(chosen, sents).first().summary.split("\n"))


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, TEXT), (2, "")], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    seen = []
    query = summarize_stream(docs, lambda df, epoch: seen.extend(df.collect()), str(tmp_path / "cp"), replace(Config(), length=2, unit="SENTENCES"))
    query.processAllAvailable()
    query.stop()
    assert [r.set_id for r in seen] == [1] and seen[0].summary.count("\n") == 1
