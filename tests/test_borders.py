import random

from abridge.operators.borders import abbreviation_scores, bordered, learn_borders, pair_counts


def _corpus(n=400):
    """Plain sentences, with dr. and e.g. as abbreviations that never stand without their stop, in a language of their own."""
    rng = random.Random(4)
    nouns, verbs = [f"{a}{b}n" for a in "bcdfgklm" for b in ("ave", "ilo", "omu")], ["sees", "takes", "holds", "makes"]
    out = []
    for k in range(n):
        parts = []
        for _ in range(rng.randrange(3, 9)):
            s = f"The {rng.choice(nouns)} {rng.choice(verbs)} a {rng.choice(nouns)}"
            if rng.random() < 0.3:
                s += f" for dr. {rng.choice(nouns).title()}"
            if rng.random() < 0.2:
                s += f" with things, e.g. a {rng.choice(nouns)}"
            parts.append(s + rng.choice([".", ".", ".", "!", "?"]))
        out.append((k, " ".join(parts), "xx", len(parts)))
    return out


def test_planted_abbreviations_are_learned_and_do_not_split(spark):
    rows = _corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n int")
    learned = learn_borders(docs)
    assert {r.word for r in learned.abbreviations.collect()} == {"dr", "e.g"}
    assert {r.word for r in learned.starters.collect()} == {"the"}
    got: dict = {}
    for r in bordered(docs, learned).orderBy("set_id", "sent_idx").collect():
        got.setdefault(r.set_id, []).append(r.text)
    for k, text, _, n in rows:
        assert len(got[k]) == n and " ".join(got[k]) == text


def test_an_abbreviation_ends_a_sentence_before_a_starter(spark):
    docs = spark.createDataFrame(_corpus(), "doc_id long, text string, lang string, n int")
    learned = learn_borders(docs)
    odd = spark.createDataFrame(
        [(1, "He asks the dr. The bilon sees a camun.", "xx"), (2, "Wait... no. Wait... Yes (it is.) So", "xx"), (3, None, "xx"), (4, " ", None), (5, "Mr. X. is 3. of them. Dr. Y goes.", None), (5, "Again. And again.", None)],
        "doc_id long, text string, lang string",
    )
    got: dict = {}
    for r in bordered(odd, learned).orderBy("set_id", "sent_idx").collect():
        got.setdefault(r.set_id, set()).add(r.text)
    assert got == {
        1: {"He asks the dr.", "The bilon sees a camun."}, 2: {"Wait... no.", "Wait...", "Yes (it is.)", "So"},
        5: {"Mr.", "X. is 3. of them.", "Dr.", "Y goes.", "Again.", "And again."},
    }


def test_languages_are_learned_apart_and_empty_tables_hold(spark):
    docs = spark.createDataFrame([(*r[:2], "yy" if r[0] % 2 else "xx", 0) for r in _corpus()], "doc_id long, text string, lang string, n int")
    assert {(r.lang, r.word) for r in learn_borders(docs).abbreviations.collect()} == {(a, b) for a in ("xx", "yy") for b in ("dr", "e.g")}
    none = docs.limit(0)
    assert bordered(none, learn_borders(none)).collect() == [] and abbreviation_scores(pair_counts(none)).collect() == []
