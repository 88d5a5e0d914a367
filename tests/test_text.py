from pyspark.sql import functions as F

from abridge.functions import text as T
from abridge.functions.stem import porter


def test_sentences(spark):
    docs = spark.createDataFrame([(1, "One two three four. Next has four words!  ...  Short one.\nNo end here at all"), (2, ""), (3, None)], "doc_id long, text string")
    rows = [(r.set_id, r.sent_idx, r.text) for r in T.sentences(docs).orderBy("set_id", "sent_idx").collect()]
    assert rows == [(1, 0, "One two three four."), (1, 1, "Next has four words!"), (1, 2, "No end here at all")]


def test_several_documents_of_a_set(spark):
    docs = spark.createDataFrame([(1, 1, "b b b b. c c c c."), (1, 0, "a a a a.")], "s long, p int, text string")
    rows = [(r.sent_idx, r.text) for r in T.sentences(docs, "s", order_col="p").orderBy("sent_idx").collect()]
    assert rows == [(0, "a a a a."), (1, "b b b b."), (2, "c c c c.")]


def test_stems(spark):
    pairs = {
        "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "meetings": "meet", "matting": "mat", "mating": "mate",
        "milling": "mill", "messing": "mess", "meeting": "meet", "agreed": "agre", "disabled": "disabl", "relational": "relat", "hopefulness": "hope", "sky": "sky", "happy": "happi", "at": "at", "controll": "control",
    }
    got = {r.word: r.stem for r in porter(spark.createDataFrame([(w,) for w in pairs], "word string")).collect()}
    assert got == pairs


def test_predicates(spark):
    row = spark.createDataFrame([("He,", "HER!", "they")], "a string, b string, c string").select(T.is_male(F.col("a")), T.is_female(F.col("b")), T.is_possessive(F.col("b")), T.is_plural(F.col("c")), T.is_pronoun(F.col("c"))).first()
    assert tuple(row) == (True, True, True, True, True)
