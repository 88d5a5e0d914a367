import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from abridge.llm import decontamination, language, packing, sentencepieces, sharding, toxicity, url_filter
from abridge.llm.token_counts import token_counts

ODD = ["a  b   c", "<|endoftext|> x <|endoftext|>", "  lead", "trail  ", "\n\n x\t y", "é à  ñ", "日本語 テスト🙂", "don't   'll I've", "x" * 3000, "", None, " ", "   ", "a \n b", "١٢٣ ½ Ⅷ", "<s> hi </s> <unk> <0x0A>"]
BPE, SPM = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def _docs(spark, texts=ODD):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_token_counts_are_the_librarys(spark):
    tokens = Tokenizer.from_file(BPE)
    for r in token_counts(_docs(spark), BPE, 5).collect():
        text = ODD[r.doc_id] or ""
        n = len(tokens.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 5)


def test_packing_round_trip(spark):
    tokens = Tokenizer.from_file(BPE)
    rows = packing.pack_token_ids(_docs(spark), BPE, length=64).collect()
    ids, places, back = packing.as_matrix(rows, length=64), packing.as_matrix(rows, "positions", 64), {}
    for m, p, r in zip(ids, places, rows):
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_ids
        for doc, offset, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            assert p[a:b].tolist() == list(range(b - a))
            back.setdefault(doc, []).append((offset, m[a:b].tolist()))
    for k, text in enumerate(ODD):
        assert sum((x for _, x in sorted(back.get(k, []))), []) == tokens.encode(text or "", add_special_tokens=False).ids
    assert len({r.row_id for r in rows}) == len(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_decreasing(sizes):
    got = packing.best_fit_decreasing(np.array(sizes, int), 40)
    room, rows = [], []
    for k in np.argsort(-np.array(sizes, int), kind="stable"):
        fits = [(room[i], i) for i in range(len(room)) if room[i] >= sizes[k]]
        if fits:
            i = min(fits)[1]
            room[i] -= sizes[k]
            rows[i].append(k)
        else:
            room.append(40 - sizes[k])
            rows.append([k])
    assert sorted(sum(got, [])) == list(range(len(sizes)))
    assert sorted(sum(sizes[k] for k in r) for r in got) == sorted(sum(sizes[k] for k in r) for r in rows)


def test_sentencepiece_ids_are_the_librarys(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=SPM)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("abehinst éo \n") for _ in range(700)) for _ in range(6)]
    rows = sentencepieces.encode_pieces(_docs(spark, texts), SPM, chunk=100).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.piece_ids == sp.encode(r.text or "") and r.round_trip
    decoded = sentencepieces.decode_pieces(sentencepieces.encode_pieces(_docs(spark, texts), SPM, chunk=100), SPM)
    assert all(r.decoded == (r.text or "") for r in decoded.collect())


def test_scan_is_the_product_in_turn():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 5, 14)
    ms = [np.where(rng.random((a, b)) < 0.3, -np.inf, rng.integers(-9, 0, (a, b)).astype(float)) for a, b in zip(sizes, sizes[1:])]
    total = ms[0]
    for k, got in enumerate(sentencepieces.scan(ms)):
        total = ms[0] if k == 0 else sentencepieces.product(total, ms[k])
        assert (got == total).all()


def _distance(p, t):
    before = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        now = [i]
        for j in range(1, len(t) + 1):
            now.append(min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (p[i - 1] != t[j - 1])))
        before = now
    return min(before)


def test_leaks_against_a_full_search(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcd") for _ in range(2))
    items = [[word() for _ in range(n)] for n in (1, 4, 12, 30, 70, 90)]
    docs = [[], ["aa"] * 40]
    for item in items:
        for edits in (0, 1, 3, 6, 20):
            body = list(item)
            for _ in range(edits):
                k = rng.randrange(len(body))
                body[k : k + 1] = rng.choice([[], [word()], [body[k], word()]]) if len(body) > 1 else [word()]
            docs.append([word() for _ in range(rng.randint(0, 30))] + body + [word() for _ in range(rng.randint(0, 30))])
    frame = spark.createDataFrame([(i, " ".join(d).upper() + "!", "c") for i, d in enumerate(docs)] + [(999, None, "c")], "doc_id long, text string, distance string")
    bench = spark.createDataFrame([(i, ", ".join(t)) for i, t in enumerate(items)] + [(77, None), (78, "...")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.contaminations(frame, bench).collect()}
    want = {(i, k): d for i, doc in enumerate(docs) for k, t in enumerate(items) if (d := _distance(t, doc)) <= int(0.2 * len(t))}
    assert got == want
    clean = {r.doc_id for r in decontamination.decontaminated(frame, bench).collect()}
    assert clean == ({*range(len(docs))} | {999}) - {i for i, _ in want}
    assert decontamination.contaminations(frame, bench.limit(0)).count() == 0


@pytest.mark.parametrize("kind, name", [("long", 5), ("string", "q5")])
def test_items_without_an_id_are_searched(spark, kind, name):
    docs = spark.createDataFrame([(1, "so one two three four it is"), (2, "five six seven eight"), (3, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two three four"), (name, "five six seven eight"), (None, None)], f"item_id {kind}, text string")
    got = sorted((r.doc_id, r.item_id, r.distance) for r in decontamination.contaminations(docs, bench).collect())
    assert got == [(1, None, 0), (2, name, 0)]
    assert [r.doc_id for r in decontamination.decontaminated(docs, bench).collect()] == [3]


def test_globs():
    rng = random.Random(3)
    import re

    def regex(g):
        return re.compile("".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in re.findall(r"\*\*|\*|\?|.", g, re.S)), re.S)

    globs = ["".join(rng.choice(["a", "b", "/", ".", "*", "**", "?"]) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    texts = ["".join(rng.choice("ab/.") for _ in range(rng.randint(0, 20))) for _ in range(200)] + [""]
    column = pa.array(texts, pa.large_string())
    hit = url_filter.Automaton(globs).matches(*url_filter.textkit.raw(column))
    for i, t in enumerate(texts):
        assert hit[i].tolist() == [bool(regex(g).fullmatch(t)) for g in globs]


def test_urls(spark):
    urls = ["https://A.Example.net/en/x?q", "http://example.net/de", "x.net/en/", None, "http://net/", "ftp://b.org/fr/#z", "http://spam-a.example.org/x", "http://evil.com/a.net/", "http://x.net"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got == {
        0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("example.net", "/de", "net/", "block"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("net", "/", "net/", "block"),
        5: ("b.org", "/fr/", "org/fr/", "allow"), 6: ("spam-a.example.org", "/x", None, "block"), 7: ("evil.com", "/a.net/", None, "allow"), 8: ("x.net", "", None, "allow"),
    }


def test_shards(spark):
    rows = [(i, None if i % 9 == 0 else f"t{i % 5}", ["a"] * 6 + ["b"] * 2 + [None, "c"]) for i in range(203)]
    docs = spark.createDataFrame([(i, t, s[i % 10]) for i, t, s in rows], "doc_id long, text string, source string")
    got = sharding.stratified_shards(docs, 7).toPandas()
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 7
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    of = {i: s[i % 10] for i, _, s in rows}
    shares = [np.mean([of[i] == "a" for i in g.doc_id]) for _, g in got.groupby("shard")]
    assert max(shares) - min(shares) < 0.08
    for i, t, _ in rows[:20]:
        row = got[got.doc_id == i].iloc[0]
        assert (row["size"], row.text_crc32) == (len(t or "") + 16, zlib.crc32((t or "").encode()))
    assert sharding.stratified_shards(docs.limit(0), 7).count() == 0


def test_write_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * i, "s") for i in range(20)], "doc_id long, text string, source string")
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 4


def test_toxicity(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for i in range(300):
        body = [word() for _ in range(40)]
        if i % 3 == 0:
            body[rng.randrange(40)] = rng.choice(["zonkhead", "zonkheads", "Z0nkhead", "zоnkhéad"])
        elif i % 3 == 1:
            body[10:10] = ["zonk", "melody"]
        texts.append((i, " ".join(body), int(i % 3 == 0)))
    docs, labels = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string"), spark.createDataFrame([(i, y, 1) for i, _, y in texts], "doc_id long, toxic int, text int")
    lexicon = toxicity.learn_lexicon(docs, labels.where("doc_id < 200"))
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "ZONKHEAD"), (1003, "plain words here")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs.union(odd), lexicon).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in texts if i >= 200]) > 0.97
    assert [got[k].predicted for k in (1000, 1001, 1002, 1003)] == [0, 0, 1, 0]
    assert all(0 <= r.score <= 1 for r in got.values())
    none = toxicity.learn_lexicon(docs, labels.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score_toxicity(docs.limit(5), none).collect()} == {0}


def test_gradients_are_the_numerical_ones():
    net = language.LanguageNet(["a", "b", "c"], hidden=4)
    for part in (net.right.p, net.left.p, net.out):
        for k in part:
            part[k] = part[k].astype(np.float64)
    x, y = np.frombuffer(b"abcdbcda", np.uint8).reshape(2, 4), np.array([0, 2])
    _, g = net.loss_and_gradients(x, y)
    rng = np.random.default_rng(0)
    for name, p in net.parameters().items():
        flat = p.reshape(-1)
        live = np.flatnonzero(g[name].reshape(-1))
        for k in rng.choice(live, min(4, len(live)), replace=False):
            old = flat[k]
            ends = []
            for e in (1e-3, -1e-3):
                flat[k] = old + e
                ends.append(net.loss_and_gradients(x, y)[0])
            flat[k] = old
            assert g[name].reshape(-1)[k] == pytest.approx((ends[0] - ends[1]) / 2e-3, rel=0.05, abs=2e-4)


def test_language(spark):
    rng = random.Random(6)
    make = lambda syllables: " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(30))
    rows = [(i, make(["the", "ing", "and"] if i % 2 else ["ción", "que", "los"]), "en" if i % 2 else "es", "x") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    net = language.learn_languages(docs.where("doc_id < 60"))
    odd = spark.createDataFrame([(900, None, None, "x"), (901, "", None, "x"), (902, "123 ...", None, "x")], docs.schema)
    got = {r.doc_id: r for r in language.identify_language(docs.union(odd), net).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in rows[60:]]) > 0.95
    assert [(got[k].lang_pred, got[k].lang_score) for k in (900, 901, 902)] == [("und", 0.0)] * 3
    empty = language.learn_languages(docs.limit(0))
    assert {r.lang_pred for r in language.identify_language(docs.limit(3), empty).collect()} == {"und"}


def test_language_learns_from_the_inside_of_long_words(spark):
    rng = random.Random(7)
    make = lambda signs: "z" * 40 + "".join(rng.choice(signs) for _ in range(400))
    rows = [(i, make("abcd" if i % 2 else "efgh"), "x" if i % 2 else "y") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.learn_languages(docs.where("doc_id < 40"))
    got = {r.doc_id: r.lang_pred for r in language.identify_language(docs.where("doc_id >= 40"), net).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows[40:]]) > 0.95


def test_language_learns_every_label(spark):
    rows = [(i, "word", f"l{i % 501:03}") for i in range(1002)]
    net = language.learn_languages(spark.createDataFrame(rows[:-1], "doc_id long, text string, lang string"))  # l500 is the rarest
    assert net.names == [f"l{i:03}" for i in range(501)]
