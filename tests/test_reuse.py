import pytest
from pyspark.sql import functions as F

from abridge import api
from abridge.config import Config
from abridge.functions.text import sentences
from abridge.operators import cluster, render
from abridge.sources.clusterings import ClusteringStore
from abridge.sources.pages import write_pages

TEXT = "Cats chase small mice daily. Cats chase small birds daily. Rain fell on the town today. The town saw heavy rain today. Mice fear all cats here."


def test_only_changed_sets_are_clustered_again(spark, tmp_path):
    store, made = ClusteringStore(str(tmp_path / "store"), "thirds-1"), []

    def make(sents):
        made.append({r.set_id for r in sents.select("set_id").distinct().collect()})
        return sents.select("set_id", "sent_idx", (F.col("sent_idx") % 3).alias("k"))

    docs = [(k, f"Set {k} has its own words here. Another sentence of {k} follows now. Another sentence of {k} follows now.") for k in range(50)] + [(50, "Set 3 has its own words here. Another sentence of 3 follows now. Another sentence of 3 follows now.")]
    rows = lambda d: {(r.set_id, r.sent_idx): (r.k, r.fresh) for r in store.clustered(sentences(spark.createDataFrame(d, "doc_id long, text string")), make).collect()}
    first = rows(docs)
    assert first == {(s, i): (i, True) for s in range(51) for i in range(3)}
    docs[7] = (7, docs[7][1] + " And a new one comes here.")
    docs[8] = (8, "Another sentence of 8 follows now. Set 8 has its own words here. Another sentence of 8 follows now.")  # another order
    second = rows(docs)
    assert made == [set(range(50)), {7}]
    assert {s for (s, _), (_, fresh) in second.items() if fresh} == {7} and len(second) == 154
    assert [second[8, i][0] for i in range(3)] == [1, 0, 2]
    assert rows(docs[:9]) == {k: (v[0], False) for k, v in second.items() if k[0] < 9}


def test_sets_of_a_row_are_reused_without_a_shuffle_of_texts(spark, tmp_path):
    docs = [(k, f"Set {k} has its own words here. Another sentence of {k} follows now. Words of {k} are here. Another sentence of {k} follows now.") for k in range(30)] + [(30, None), (31, "Too short.")]
    docs += [(32, "Another sentence of 3 follows now. Set 3 has its own words here. Another sentence of 3 follows now. Words of 3 are here.")]  # the sentences of set 3
    frame = lambda d: spark.createDataFrame(d, "set_id long, text string")
    by_rows, by_joins = (ClusteringStore(str(tmp_path / at), "words-7") for at in ("rows", "joins"))
    for fresh in (set(range(30)) | {32}, {5}):
        new = by_rows.clustered_rows(frame(docs), cluster.rows_by_shared_words)
        old = by_joins.clustered(sentences(frame(docs), "set_id"), cluster.by_shared_words)
        assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect()))
        assert {r.set_id for r in new.where("fresh").collect()} == fresh
        assert "text" not in str(new._jdf.queryExecution().optimizedPlan())
        docs[5] = (5, docs[5][1] + " And a new one comes here.")
    again = by_joins.clustered_rows(frame(docs), cluster.rows_by_shared_words)  # a store is the same for both ways
    assert {r.set_id for r in again.where("fresh").collect()} == {5} and again.count() == new.count() + 1


def test_pages_appear_whole_or_not_at_all(spark, tmp_path):
    out = tmp_path / "site"
    write_pages(spark.createDataFrame([(k, f"Title <{k}>", f"<p>page {k} é</p>") for k in range(1, 8)], "place int, title string, html string").repartition(3), str(out))
    assert sorted(p.name for p in out.iterdir()) == ["index.html", *(f"page-{k:06d}.html" for k in range(1, 8))]
    assert (out / "page-000003.html").read_text() == "<p>page 3 é</p>"
    index = (out / "index.html").read_text()
    assert index.index("page-000001") < index.index("page-000007") and "Title &lt;2&gt;" in index
    with pytest.raises(Exception, match="place and text"):
        write_pages(spark.createDataFrame([(1, "new", "<p>new</p>"), (2, "t", None)], "place int, title string, html string").repartition(2), str(out))
    assert (out / "page-000001.html").read_text() == "<p>page 1 é</p>" and len(list(out.iterdir())) == 8


def test_a_run_tells_what_it_did_without_another_job(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "One sentence is all there is.")], "doc_id long, text string")
    chosen, sents = api.choose(docs, Config(length=2, unit="SENTENCES", singleton=False))
    sents, chosen, of_sents, of_choice = api.observed(sents, chosen)
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert render.summary_text(chosen, sents).count() == 2
    after = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert of_sents.get["sentences"] == 6 and of_choice.get["chosen"] == 3 and of_choice.get["steps"] == 2
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == after >= before


def test_only_sets_of_many_bytes_are_counted(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "One sentence is all there is."), (3, None)], "doc_id long, text string")
    large = lambda n: {r.set_id for r in api._large(docs, sentences(docs), Config(kernel_limit=n), "doc_id", "text").collect()}
    assert large(0) == {1, 2} and large(1) == {1} and large(4) == {1} and large(5) == set()
