"""Queries on sets of one row each: the same results as by joins, and no rows of terms or pairs in a shuffle."""

from collections import Counter

from pyspark.sql import functions as F

from abridge.config import Config
from abridge.functions import text as T
from abridge.functions.stem import STEP2, STEP3, STEP4, porter, porter_word
from abridge.operators import borders, cluster, combine, measures, render, select, terms
from abridge.operators.density import density_clusters

TEXTS = [
    (1, "The red fox runs far away. The red fox sleeps far away! A blue bird sings the red song? The red fox runs far away."),
    (2, "One line of four words here."),
    (3, ""),
    (4, None),
    (5, "Ab cd ef gh. Ij kl mn op. Ab cd ij kl. Ab ab ab ab."),
]


def _docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def _rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_weights_of_rows_without_shuffle(spark):
    docs, stop = _docs(spark), ("the",)
    s = T.sentences(docs)
    bags = terms.bag(s, stop, bigrams=True)
    old = terms.idf(bags, ("sent_idx",), docs=s)
    freq = terms.document_frequencies(docs, stop, True)
    assert _rows(freq) == _rows(old)
    new = terms.placed_weights(terms.document_weights(docs, stop, True))
    assert _rows(new) == _rows(terms.weighted(bags, old))
    assert _exchanges(freq) == _exchanges(new) == 0


def test_cosine_by_an_index(spark):
    docs, stop = _docs(spark), ("the",)
    s = T.sentences(docs)
    w = terms.weighted(terms.bag(s, stop, bigrams=True), terms.idf(terms.bag(s, stop, bigrams=True), ("sent_idx",), docs=s))
    new = measures.indexed_cosine(terms.document_weights(docs, stop, True))
    assert _rows(new) == _rows(measures.tfidf_cosine(w, terms.norms(w)))


def test_distances_of_rows(spark):
    docs, stop = _docs(spark).union(spark.createDataFrame([(6, "The the the the. Ab cd ef gh. Ab cd ij kl.")], "doc_id long, text string")), ("the",)
    s = T.sentences(docs)
    bags = terms.bag(s, stop)
    w = terms.weighted(bags, terms.idf(bags, ("sent_idx",), docs=s))
    for kind, old in (("idf", measures.idf_distance), ("tfidf", measures.tfidf_euclidean)):
        new = select.distance_pairs(docs, Config(bigrams=False), kind, stop)
        assert _rows(new) == _rows(old(w, terms.norms(w)))
        assert _exchanges(new) == 0


def test_combined_pairs_of_rows(spark):
    docs, stop, pos, neg = _docs(spark), ("the",), ("red", "ab"), ("far", "red")
    config = Config(bigrams=False)
    f = measures.sentiment_fractions(T.sentences(docs), pos, neg)
    stack = combine.stacked([measures.sentiment_pairs(f, "pos"), measures.sentiment_pairs(f, "neg"), select.cosine_pairs(docs, config, stop)])
    for how in ("mult", "avg", "l2", "l100", "max", "min"):
        new = select.combined_pairs(docs, config, how, pos, neg, stop)
        assert _rows(new) == _rows(combine.combined(stack, 3, how))
        assert _exchanges(new) == 0


def test_clusters_of_rows(spark):
    docs, stop, config = _docs(spark), ("the",), Config()
    s, cos = T.sentences(docs), select.cosine_pairs(docs, Config(), stop)
    medoids = cluster.seeded_medoids(s)
    once, full = cluster.assigned(s, medoids, cos), select.with_diagonal(cos, s)
    first = s.where("sent_idx < 2").select("set_id", "sent_idx")
    pairs = [
        (select.document_assigned(docs, config, stop), once),
        (select.document_best_medoids(docs, config, stop), cluster.best_medoids(once, cos)),
        (select.document_utility(docs, config, stop), cluster.utility(once, medoids, cos)),
        (select.document_coverage(docs, config, 2, stop), select.coverage_score(first, full, select.degrees(full, s))),
        (select.document_pruned(docs, Config(prune=0.4), stop), select.pruned(full, s)),
        (select.document_swap_gains(docs, config, 3, stop), cluster.swap_gains(s, cluster.seeded_medoids(s, k=F.lit(3)), cos)),
    ]
    for new, old in pairs:
        assert _rows(new) == _rows(old)
        assert _exchanges(new) == 0


def test_running_length_from_lines(spark):
    chosen = spark.createDataFrame([(1, 1, 4, "a b c."), (1, 2, 0, "d é")], "set_id long, step int, sent_idx int, line string")
    assert _rows(render.running_length(chosen).select("set_id", "step", "sent_idx", "words_so_far")) == [(1, 1, 4, 3), (1, 2, 0, 5)]


def test_density_makes_pairs_once(spark):
    sents = spark.createDataFrame([(1, k) for k in range(5)], "set_id long, sent_idx int")
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(1, 0, 1, 0.9), (1, 1, 2, 0.85), (1, 2, 3, 0.8), (1, 3, 4, 0.3)]
    pairs = spark.createDataFrame(rows, "set_id long, i int, j int, s double").mapInArrow(count, "set_id long, i int, j int, s double")
    assert _rows(density_clusters(sents, pairs, 0.2, 3)) == [(1, 0, 0), (1, 1, 0), (1, 2, 0), (1, 3, 0), (1, 4, -1)]
    assert made.value == len(rows)


def test_tokens_are_counted_before_patterns(spark):
    counts = borders.pair_counts(spark.createDataFrame([("en", 'He said "go." Then "go." Then go, go'), (None, None)], "lang string, text string"))
    assert _rows(counts.where("word = 'go' and stop")) == [("en", "go", True, "then", True, 2)]
    assert _exchanges(counts) == 2  # of distinct tokens, then of words


def test_sentences_end_at_the_last_token(spark):
    docs = spark.createDataFrame([(1, "en", "One two! Three... four Five... Six. seven"), (2, "en", "Only."), (3, "en", " "), (4, None, "No sign")], "doc_id long, lang string, text string")
    assert [r[2] for r in _rows(borders.bordered(docs, borders.learn_borders(docs)))] == ["One two!", "Three... four Five...", "Six.", "seven", "Only.", "No sign"]


def test_bags_of_stems_without_shuffle(spark, monkeypatch):
    docs = _docs(spark).union(spark.createDataFrame([(6, "Hopping ponies agreed relational motoring. Falling the ponies controlled hoping ponies. The ponies pony the ponies.")], "doc_id long, text string"))
    s = T.sentences(docs)
    for stemmer in ("porter", "porter2"):
        want = {}
        for r in terms.with_terms(terms.occurrences(s), ("the", "ponies"), stemmer).collect():
            want.setdefault((r.set_id, r.sent_idx), {})[r.pos] = r
        found = Counter()
        for key, at in want.items():
            row = [at[k] for k in sorted(at)]
            found.update((*key, r.term) for r in row if not r.is_stop)
            found.update((*key, f"{a.term} {b.term}") for a, b in zip(row, row[1:]))
        for most in (terms.COUNTED, 5):
            monkeypatch.setattr(terms, "COUNTED", most)
            new = terms.bag(s, ("the", "ponies"), stemmer, True)
            assert _rows(new) == sorted((*k, n) for k, n in found.items())
            assert _rows(terms.bag(s, ("the", "ponies"), stemmer)) == sorted((*k, n) for k, n in found.items() if " " not in k[2])
            assert _exchanges(new) == 0


def test_stems_of_words_by_the_same_rules(spark):
    heads = ("hop", "agr", "tr", "y", "sky", "fall", "cry", "relat", "oper", "éco", "x", "", "sens", "a")
    tails = (*STEP2, *STEP3, *STEP4, "s", "ss", "sses", "ies", "eed", "ed", "ing", "pping", "ated", "bled", "ized", "lling", "y", "e", "ll", "ell", "ness", "sion", "tion", "rion")
    words = spark.createDataFrame([(h + t + u,) for h in heads for t in tails for u in ("", "s", "ed", "e")], "word string").where("word <> ''").distinct()
    assert [(r.word, r.stem) for r in porter(words).collect() if r.stem != porter_word(r.word)] == []
