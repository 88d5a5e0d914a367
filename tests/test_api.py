import struct
from dataclasses import replace

import numpy as np
import pytest

import __spark_entry__ as entry
from abridge import __main__ as cli
from abridge import api
from abridge.config import Config
from abridge.operators import combine
from abridge.operators.anaphora import resolve_pronouns, resolve_with_entities, resolve_with_tags
from abridge.operators.cluster import kernel_medoids
from abridge.operators.select import kernel_select
from abridge.sources.lists import Lists, from_files
from tests.test_select import W
from abridge.functions.text import sentences
from abridge.sources import readers, writers

TEXT = "Cats chase small mice daily. Cats chase small birds daily. Rain fell on the town today. The town saw heavy rain today. Mice fear all cats here."


def test_summary_of_a_text(spark):
    found = api.summarize_text(spark, TEXT, 2, "SENTENCES")
    assert len(found.split("\n")) == 2 and set(found.split("\n")) < set(s.strip() + "." for s in TEXT.split("."))
    assert api.summarize_text(spark, "") == ""


def test_other_measures(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "One sentence is all there is.")], "doc_id long, text string")
    rows = {r.set_id: r.summary for r in api.summarize(docs, Config(length=2, unit="SENTENCES", use_sentiment=True)).collect()}
    assert set(rows) == {1, 2}


WORDS = Lists(stop=("the", "on", "all"), positive=("good", "heavy"), negative=("stupid", "fear"))
OPTIONS = [
    {"clusterings": "each", "mean_diversity": True}, {"clustering": "pam"}, {"clustering": "distances"},
    {}, {"pronouns": ("she",)}, {"prune": 0.2}, {"aggregate": "avg", "cluster_on_aggregate": True}, {"aggregate": "l2"}, {"aggregate": "max", "strict_length": True, "length": 13, "unit": "WORDS"},
    {"aggregate": "min", "cost_weight": True}, {"use_sentiment": False, "mean_diversity": True}, {"use_sentiment": False, "singleton": True, "length": 12, "unit": "WORDS"}, {"stemmer": "porter2"}, {"use_tfidf": False},
]


@pytest.mark.parametrize("more", OPTIONS)
def test_joins_choose_what_a_task_chooses(spark, more):
    text = TEXT + " She saw rain and good small cats today. A good town fears stupid birds daily."
    docs = spark.createDataFrame([(1, text), (2, "One good sentence is all there is."), (3, "")], "doc_id long, text string")
    config = Config(**{"length": 4, "unit": "SENTENCES", "use_sentiment": True, "singleton": False} | more)
    rows = lambda c: sorted((r.set_id, r.step, r.sent_idx, round(r.score, 6)) for r in api.choose(docs, c, lists=WORDS)[0].collect())
    one, other = rows(config), rows(replace(config, kernel_limit=0))
    assert one == other and {r[0] for r in one} <= {1, 2} and len(one) > 1


def test_features_are_the_pair_measures(spark):
    """Measures made in a task, and the same given as matrices."""
    vectors = spark.createDataFrame([("cats", [1.0, 0.0]), ("rain", [0.0, 1.0]), ("town", [0.6, 0.8]), ("small", [0.1, -0.3])], "word string, vec array<double>")
    lists = replace(WORDS, vectors=vectors, dim=2)
    docs = spark.createDataFrame([(1, TEXT + " Nothing here has a vector.")], "doc_id long, text string")
    for aggregate in ("mult", "l3"):
        config = Config(length=4, unit="SENTENCES", use_sentiment=True, use_embeddings=True, aggregate=aggregate, singleton=False)
        chosen, sents = api.choose(docs, config, lists=lists)
        found = api.pair_measures(sents, config, lists)
        near = api.pair_measures(sents, Config(), lists)[0]
        again = api.select.select_by_matrix(combine.stacked(found), len(found), sents, config, near)
        want = [(r.sent_idx, round(r.score, 6)) for r in chosen.orderBy("step").collect()]
        assert want == [(r.sent_idx, round(r.score, 6)) for r in again.orderBy("step").collect()]


def test_left_out(spark):
    docs = spark.createDataFrame([(1, TEXT + " She saw rain and small cats today.")], "doc_id long, text string")
    chosen = lambda **more: {r.sent_idx for r in api.choose(docs, Config(length=99, unit="SENTENCES", use_sentiment=True, singleton=False, **more))[0].collect()}
    everything = chosen()
    assert chosen(pronouns=("she",)) == everything - {max(everything)} and len(chosen(prune=0.1)) == len(everything) - 1


def test_step_weights_and_clusterings(spark):
    pairs = [spark.createDataFrame([(1, i, j, float(W[i, j] * f)) for i in range(6) for j in range(i + 1, 6) if W[i, j]], "set_id long, i int, j int, s double") for f in (1.0, 0.5)]
    sents = spark.createDataFrame([(1, i, "t", ["t"]) for i in range(6)], "set_id long, sent_idx int, text string, tokens array<string>")
    config = Config(length=4, unit="SENTENCES", aggregate="avg", singleton=False, cluster_on_aggregate=True)
    pick = lambda **more: [r.sent_idx for r in api.select.select_by_matrix(combine.stacked(pairs), 2, sents, replace(config, **more.pop("config", {})), **more).orderBy("step").collect()]
    off = W - np.eye(6)
    first = kernel_select(W, kernel_medoids(W), np.ones(6), np.ones(6), config)
    assert pick(steps=[[1.0, 0.0]] * 5) == [k for k, _ in first]  # the first matrix alone
    half = 0.5 * off + 0.25 * off + np.eye(6)
    assert pick() == [k for k, _ in kernel_select(half, kernel_medoids(half), np.ones(6), np.ones(6), config)]
    several = [kernel_medoids(off * f + np.eye(6)) for f in (1.0, 0.5)]
    want = kernel_select(half, several, np.ones(6), np.ones(6), replace(config, mean_diversity=True))
    assert pick(config={"clusterings": "each", "mean_diversity": True}) == [k for k, _ in want]


def test_lists_and_idf_corpus(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("cats\n\n daily \n")
    (tmp_path / "idf").mkdir()
    (tmp_path / "idf/a.txt").write_text("cats chase mice\nrain fell")
    (tmp_path / "idf/b.txt").write_text("cats sleep")
    lists = from_files(spark, stop=str(tmp_path / "stop.txt"), idf_directory=str(tmp_path / "idf"))
    assert lists.stop == ("cats", "daily")
    sents = sentences(spark.createDataFrame([(1, TEXT)], "doc_id long, text string"))
    rows = {(r.sent_idx, r.term): r.idf for r in api.tfidf_weights(sents, Config(), lists=lists).collect()}
    assert (0, "cats") not in rows and rows[0, "chase"] == pytest.approx(np.log10(2)) and rows[0, "cats chase"] == pytest.approx(np.log10(2)) and rows[2, "town"] == 1.0
    assert api.choose(spark.createDataFrame([(1, TEXT)], "doc_id long, text string"), Config(length=2, unit="SENTENCES"), lists=lists)[0].count() == 2


def test_command_line(spark, tmp_path):
    (tmp_path / "doc.txt").write_text(TEXT)
    (tmp_path / "m.txt").write_text("1, 0.5, 0.1;\n0.5, 1, 0;\n0.1, 0, 1;\n")
    (tmp_path / "s.txt").write_text("a b c\nd e f\ng h i\n")
    (tmp_path / "k.txt").write_text("0\n1\n1\n")
    (tmp_path / "w.txt").write_text("1 0\n")
    said = lambda *args: cli.run(spark, cli.parser().parse_args([str(tmp_path / a) if (tmp_path / a).exists() else a for a in args]))
    text = said("doc.txt", "--nb-sentences", "2")
    assert len(text.split("\n")) == 2 and set(text.split("\n")) < {s.strip() + "." for s in TEXT.split(".")}
    assert len(said("doc.txt", "--numerical", "--summary-length", "1", "--summary-length-unit", "SENTENCES", "--stemmer", "porter", "--flag", "MOD_COST_WEIGHT", "--flag", "MOD_PRUNE").split()) == 1
    assert said("--m", "m.txt", "--s", "s.txt", "--nb-sentences", "2").count("\n") == 1
    assert said("--m", "m.txt", "m.txt", "--s", "s.txt", "--nb-sentences", "2", "--weights-file", "w.txt", "--flag", "MOD_R1SUPER", "--flag", "MOD_MATRIX_L2").count("\n") == 1
    assert said("--matrix-file", "m.txt", "--s", "s.txt", "--nb-words", "3", "--clustering-file", "k.txt", "--print-as-text") in ("a b c", "d e f", "g h i")
    with pytest.raises(SystemExit):
        said("--nb-words", "3")


def test_matrix_file(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1, 0.5, 0.1;\n0.5, 1, 0;\n0.1, 0, 1;\n")
    (tmp_path / "s.txt").write_text("a b c\nd e f\ng h i\n")
    rows = readers.similarity_matrix(spark, str(tmp_path / "m.txt")).collect()
    assert len(rows) == 9 and {(r.i, r.j): r.s for r in rows}[0, 1] == 0.5
    assert api.summarize_matrices(spark, [str(tmp_path / "m.txt")], str(tmp_path / "s.txt"), Config(length=2, unit="SENTENCES", singleton=False)).count() == 2
    (tmp_path / "bad.txt").write_text("1, 2\n3\n")
    with pytest.raises(Exception, match="square"):
        readers.similarity_matrix(spark, str(tmp_path / "bad.txt")).collect()


def test_small_files(spark, tmp_path):
    (tmp_path / "w.txt").write_text("0.5 0.25 1 0\n")
    assert [(r.step, r.matrix_id, r.w) for r in readers.matrix_weights(spark, str(tmp_path / "w.txt"), 2).orderBy("step", "matrix_id").collect()] == [(0, 0, 0.5), (0, 1, 0.25), (1, 0, 1.0), (1, 1, 0.0)]
    (tmp_path / "c.txt").write_text("cat dog\ncat bird\n")
    assert {r.word: r.cluster_id for r in readers.word_clusters(spark, str(tmp_path / "c.txt")).collect()} == {"cat": "cluster-0", "dog": "cluster-0", "bird": "cluster-1"}
    (tmp_path / "v.bin").write_bytes(b"2 3\ncat " + struct.pack("<3f", 1, 2, 3) + b"\ndog " + struct.pack("<3f", 4, 5, 6))
    assert {r.word: list(r.vec) for r in readers.word2vec_binary(spark, str(tmp_path / "v.bin")).collect()} == {"cat": [1, 2, 3], "dog": [4, 5, 6]}
    writers.save_idf(spark.createDataFrame([("b", 0.5), ("a", 1.0)], "term string, idf double"), str(tmp_path / "idf"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "idf")).collect()) == ["a: 1.0", "b: 0.5"]


def test_pronouns(spark):
    docs = spark.createDataFrame([(1, "John met Anna there today. He gave her his book.")], "doc_id long, text string")
    rows = resolve_pronouns(sentences(docs), ("john",), ("anna",)).orderBy("sent_idx").collect()
    assert rows[1].resolved == "He (John) gave her (Anna's) his (John's) book."


def test_names_of_two_parts(spark):
    docs = spark.createDataFrame([(1, "Today John Smith met Anna there. He gave her his book."), (2, "Then came John. Smith saw him and he left.")], "doc_id long, text string")
    rows = {(r.set_id, r.sent_idx): r.resolved for r in resolve_pronouns(sentences(docs, min_tokens=2), ("john",), ("anna",)).collect()}
    assert rows[1, 1] == "He (John Smith) gave her (Anna's) his (John Smith's) book." and rows[2, 1] == "Smith saw him and he (John) left."


def test_pronouns_by_entities_and_tags(spark):
    docs = spark.createDataFrame([(1, "The Firm hired Mary Poe. She liked their plan. They paid her well.")], "doc_id long, text string")
    sents = sentences(docs)
    found = spark.createDataFrame([(1, 0, 1, "ORGANIZATION", "Firm"), (1, 0, 3, "PERSON", "Mary Poe")], "set_id long, sent_idx int, pos int, type string, entity string")
    rows = [r.resolved for r in resolve_with_entities(sents, found).orderBy("sent_idx").collect()]
    assert rows[1] == "She (Mary Poe) liked their (Mary Poe's) plan." and rows[0].startswith("The Firm")
    other = found.union(spark.createDataFrame([(1, 1, 3, "ORGANIZATION", "Firm")], found.schema))
    assert resolve_with_entities(sents, other).orderBy("sent_idx").collect()[2].resolved == "They paid her (Mary Poe's) well."
    tags = spark.createDataFrame([(1, 0, 1, "NNPS"), (1, 0, 4, "NNP")], "set_id long, sent_idx int, pos int, tag string")
    rows = [r.resolved for r in resolve_with_tags(sents, tags).orderBy("sent_idx").collect()]
    assert rows[1:] == ["She (Poe) liked their (Firm's) plan.", "They (Firm) paid her (Poe's) well."]


def test_entry(spark):
    names = entry.queries()
    assert "flagship" in names and set(entry.oracle_sql()) <= set(names)
    assert np.isfinite(entry.entry(spark).count())
