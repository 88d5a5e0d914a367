"""Edge cases that the docstrings state: nulls, ties, repeated rows, long texts, empty tables, clashing names; plain versions beside the automata."""

import random

import numpy as np
import public_tokenizers
import pytest

from abridge.llm import decontamination, toxicity
from abridge.llm.decontamination import contaminations, decontaminated, myers
from abridge.llm.language import LONGEST, LanguageNet, identify_language, sequences
from abridge.llm.packing import as_matrix, pack_token_ids, write_packed
from abridge.llm.pieces import BytePieces
from abridge.llm.sentencepieces import encode_pieces
from abridge.llm.sharding import stratified_shards, write_shards
from abridge.llm.token_counts import token_counts
from abridge.llm.url_filter import Rule, judge_urls

JSON = public_tokenizers.path("byte_bpe_50k.json")


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_places_of_items():
    """Best runs and where they begin, against all runs."""
    rng = random.Random(2)
    for _ in range(300):
        pattern = [rng.randint(0, 5) for _ in range(rng.randint(1, 8))]
        text = [rng.randint(0, 5) for _ in range(rng.randint(0, 14))]
        best = min(_distance(pattern, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        found, end = myers(pattern, text)
        back, size = myers(pattern[::-1], text[:end][::-1], True)
        assert found == best == back and _distance(pattern, text[end - size : end]) == best


def test_leaks_edges(spark):
    words = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, words), (2, None), (3, " "), (None, "alpha beta gamma delta epsilon zeta")], "doc_id long, text string")
    docs = spark.createDataFrame(
        [(1, f"a b c {words.replace('four ', '')} x"), (1, f"a b c {words.replace('four', 'four extra')} x"), (2, None), (3, ""), (4, "w " * 40_000 + words), (None, "alpha beta gamma delta epsilon zeta")], "doc_id long, text string"
    )
    rows = sorted(((r.doc_id or 0, r.benchmark_doc_id or 0, r.distance, r.first_word, r.end_word) for r in contaminations(docs, items, item_col="doc_id").collect()))
    assert rows == [(0, 0, 0, 0, 6), (1, 1, 1, 3, 12), (1, 1, 1, 3, 14), (4, 1, 0, 40_000, 40_010)]
    assert sorted(r.doc_id for r in decontaminated(docs, items, item_col="doc_id").collect()) == [2, 3]
    none = spark.createDataFrame([], docs.schema)
    assert contaminations(none, items, item_col="doc_id").count() == 0 and contaminations(docs, none, item_col="doc_id").count() == 0 and decontaminated(docs, none, item_col="doc_id").count() == 6
    assert decontamination.budget(10) == 2


def test_urls_edges(spark):
    pages = spark.createDataFrame([(1, "http://A.example.net/en/x"), (1, "http://A.example.net/en/x"), (2, "http://b.net" + "/y" * 20_000), (None, None)], "page_id long, url string")
    rows = sorted(((r.page_id or 0, r.rule, r.verdict) for r in judge_urls(pages).collect()), key=repr)
    assert rows == [(0, None, "allow"), (1, "example.net/en/", "allow"), (1, "example.net/en/", "allow"), (2, "net/", "block")]
    tie = (Rule("x.org/", "allow"), Rule("b.org/", "block"))
    assert [r.rule for r in judge_urls(spark.createDataFrame([(1, "s://b.org/")], pages.schema), tie).collect()] == ["b.org/"]
    assert judge_urls(spark.createDataFrame([], pages.schema)).count() == 0


def test_packing_edges(spark, tmp_path):
    docs = spark.createDataFrame([(None, "one two"), (7, "one two"), (7, "three"), (8, None), (9, "word " * 3000)], "doc_id long, text string").coalesce(1)
    whole = BytePieces(JSON).whole
    rows = pack_token_ids(docs, JSON, length=64, end=50256).collect()
    flat = as_matrix(rows, length=64)
    got = {}
    for row, ids in zip(rows, flat):
        for a, b, doc, offset in zip(row.cu_seqlens, row.cu_seqlens[1:], row.doc_ids, row.doc_offsets):
            got.setdefault(doc, []).append((offset, ids[a:b].tolist()))
    join = lambda parts: [i for _, p in sorted(parts) for i in p]
    want = lambda text: whole.encode(text).ids + [50256]
    assert join(got[None]) == want("one two") and join(got[9]) == want("word " * 3000) and join(got[8]) == [50256]
    assert sorted(p for _, p in got[7]) == sorted([want("one two"), want("three")])
    write_packed(docs, str(tmp_path / "packed"), JSON, length=64)
    assert spark.read.parquet(str(tmp_path / "packed")).count() > 0
    assert pack_token_ids(spark.createDataFrame([], docs.schema), JSON).count() == 0 and as_matrix([]).shape == (0, 2048)


def test_shards_edges(spark, tmp_path):
    rows = [(None, f"t{k % 3}", "a") for k in range(10)] + [(5, "same", None)] * 4 + [(k, None, f"s{k}") for k in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = stratified_shards(docs, shards=7).collect()
    sizes = [sum(r.shard == k for r in got) for k in range(7)]
    assert len(got) == len(rows) and max(sizes) - min(sizes) <= 1 and all(sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k])) for k in range(7))
    clash = docs.selectExpr("doc_id", "text", "source", "1 AS shard", "2 AS slot")
    write_shards(clash, str(tmp_path / "shards"), shards=3)
    assert spark.read.parquet(str(tmp_path / "shards")).select("row.shard").distinct().collect()[0][0] == 1
    assert stratified_shards(spark.createDataFrame([], docs.schema)).count() == 0


def test_hits_against_a_plain_scan():
    rng = random.Random(4)
    lexicon = toxicity.Lexicon({" bad": 2.0, " badly ": 3.0, " ugly ": 1.0, " b": 0.5}, [" not  bad ", " badge "])
    machine = lexicon.automaton()
    words = ["bad", "badly", "badge", "ugly", "not", "fine", "b4d", "ugLy", "bádly"]
    for _ in range(300):
        folded = toxicity.fold(" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))))
        free = [(k, k + len(p) - 1) for p in lexicon.exceptions for k in range(len(folded)) if folded.startswith(p, k)]
        want = set()
        for k in range(len(folded)):
            found = [(w, p) for p, w in lexicon.weights.items() if folded.startswith(p, k)]
            if found:
                w, p = max(found)
                if not any(a <= k and k + len(p) - 1 <= b for a, b in free):
                    want.add((k, w, p))
        assert {(start, w, p) for start, _, w, p in lexicon.hits(machine, folded)} == want


def test_lexicon_prefers_whole_words_and_learns_exceptions(spark):
    rng = random.Random(1)
    filler = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(3, 5) for _ in range(12))
    rows = [(k, f"{filler()} {'pathetic' if k % 2 else 'pathos'} scumbag {filler()}", 1) for k in range(0, 200)] + [(k, f"{filler()} pathology" if k % 40 == 0 else filler(), 0) for k in range(200, 400)]
    rows += [(1000, rows[0][1], 0)]  # the same text under the other label
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(docs, labels)
    assert " scumbag " in lexicon.weights and " scum" not in lexicon.weights  # a stem of one word
    assert " path" in lexicon.weights and " pathology " in lexicon.exceptions  # a stem of two, and a clean word that it meets
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, lexicon).collect()}
    assert all(got[i] == y for i, _, y in rows if i != 1000)
    assert toxicity.learn_lexicon(docs.limit(0), labels).weights == {}


def test_language_edges(spark):
    word = "ä" * 100
    parts = sequences(word)
    assert b"".join(parts) == b" " + word.encode() + b" " and all(len(p) <= LONGEST and p.decode() for p in parts)
    net = LanguageNet(["a", "b"])
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !", "x"), (4, "word", "x"), (4, "word", "x"), (5, "w" * 200_000, "x")], "doc_id long, text string, lang_pred string")
    rows = {(r.doc_id, r.lang_pred) for r in identify_language(docs, net).collect()}
    assert {i for i, p in rows if p == "und"} == {1, 2, 3} and len(rows) == 5
    assert {r.lang_pred for r in identify_language(docs, LanguageNet([])).collect()} == {"und"} and identify_language(docs.limit(0), net).count() == 0


@pytest.mark.parametrize("text", ["", "a", " lead", "x  y\n\nz ", "<|endoftext|> in a text", "漢字 and words", "word " * 30_000])
def test_token_counts_edges(spark, text):
    docs = spark.createDataFrame([(1, text), (1, text), (None, None)], "doc_id long, text string")
    rows = token_counts(docs, JSON).collect()
    want = len(BytePieces(JSON).whole.encode(text, add_special_tokens=False).ids)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == [(0, 0, 0, False)] + [(1, len(text.encode()), want, want > 512)] * 2


def test_pieces_edges(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", "  two  blanks ", "▁sign", "\x00\u200b𐍈", "no blank" * 0 + "x" * 90_000, ("ab cd" * 9 + " ") * 1500, "word " * 8000]
    docs = spark.createDataFrame([(k, t, [1]) for k, t in enumerate(texts)] + [(99, None, [1]), (99, None, [1])], "doc_id long, text string, piece_ids array<int>")
    rows = encode_pieces(docs, path).collect()
    assert len(rows) == len(texts) + 2 and encode_pieces(docs.limit(0), path).count() == 0
    for r in rows:
        assert r.piece_ids == library.encode(r.text or "") and r.round_trip == (library.decode(r.piece_ids) == (r.text or ""))
    assert np.sum([r.round_trip for r in rows]) == len(rows) - 1  # the blank sign reads as a blank
