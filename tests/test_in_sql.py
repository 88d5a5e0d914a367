import pytest

from abridge import api
from abridge.config import Config
from abridge.functions.table import register_summaries

TEXT = "Cats chase small mice daily. Cats chase small birds daily. Rain fell on the town today. The town saw heavy rain today. Mice fear all cats here."


def test_sql_gives_what_the_api_gives(spark):
    docs = spark.createDataFrame([("a", TEXT), ("b", "One sentence is all there is."), ("c", None), ("d", TEXT.lower())], "name string, body string")
    config = Config(length=9, unit="WORDS", singleton=True)
    register_summaries(spark, config, ("the",))
    for length, unit in ((9, "WORDS"), (70, "CHARACTERS"), (2, "SENTENCES")):
        got = spark.sql(f"SELECT * FROM summarize(TABLE(SELECT name, abridge_sentences(body) AS sents FROM {{docs}}) PARTITION BY (name), {length}, '{unit}')", docs=docs)
        assert got.columns == ["name", "summary"]
        want = api.summarize(docs, Config(length=length, unit=unit), "name", "body", lists=api.Lists(stop=("the",)))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_bad_arguments_are_told_before_anything_runs(spark):
    register_summaries(spark)
    for call in ("summarize(TABLE(SELECT 1 AS a) PARTITION BY (a), 3, 'WORDS')", "summarize(TABLE(SELECT 1 AS a, abridge_sentences('x') AS sents) PARTITION BY (a), 3, 'PAGES')"):
        with pytest.raises(Exception, match="summarize takes"):
            spark.sql(f"SELECT * FROM {call}")
