"""Queries that go from the tables to files and back: pages of a digest, clusterings that are used again."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from abridge.functions.text import sentences
from abridge.operators import cluster, digest
from abridge.operators.select import scratch_path
from abridge.plans import sql as Q
from abridge.plans.catalog import docs_of, query
from abridge.sources.clusterings import ClusteringStore
from abridge.sources.pages import write_pages


@query(Q.cte(Q.sents(), r"""
d AS (SELECT doc_id, coalesce(source, '') || '/' || coalesce(lang, '') AS k FROM documents),
sz AS (SELECT k, row_number() OVER (ORDER BY count(*) DESC, k) AS place FROM d GROUP BY k),
top AS (SELECT d.*, text FROM d JOIN s ON s.set_id = d.doc_id AND s.sent_idx = 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) <= 5),
h AS (SELECT k, doc_id, regexp_replace(regexp_extract(url, '^[^:/?#]+://([^/?#:]*)', 1), '^www\.', '') AS host FROM top JOIN pages ON page_id = doc_id),
l AS (SELECT k, doc_id, CASE WHEN n > 1 THEN host || ' (' || n || ')' ELSE host END AS label FROM (SELECT *, row_number() OVER (PARTITION BY k, host ORDER BY doc_id) AS n FROM h WHERE host <> '')),
src AS (SELECT k, string_agg(label, ', ' ORDER BY doc_id) AS sources FROM l GROUP BY k),
body AS (SELECT k, replace(replace(string_agg(text, chr(10) ORDER BY doc_id), chr(10) || chr(10), chr(10)), chr(10), '<br /><br />' || chr(10)) AS text FROM top GROUP BY k)""")
+ "SELECT place, md5('<h1>Digest ' || k || '</h1>' || chr(10) || '<p>' || text || '</p>' || chr(10) || '<p>' || coalesce(sources, '') || '</p>' || chr(10)) AS page FROM body JOIN sz USING (k) LEFT JOIN src USING (k)")
def digest_pages(spark, d):
    """A page for each cluster of documents, largest first: the first sentences of five of them and the hosts of their pages; written as HTML files and read back."""
    docs = docs_of(spark, d).withColumn("k", F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit(""))))
    sizes = digest.clusters_by_size(docs.select("k"))
    first = sentences(docs).where("sent_idx = 0").select(F.col("set_id").alias("doc_id"), F.col("text").alias("line"))
    top = docs.select("doc_id", "k").join(first, "doc_id").withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("doc_id"))).where("n <= 5")
    hosts = digest.numbered_hosts(top.join(docs_of(spark, d, "pages").withColumnRenamed("page_id", "doc_id"), "doc_id"), "url", "k", "doc_id").where("host <> ''")
    in_order = lambda c, of: F.transform(F.array_sort(F.collect_list(F.struct(of, c))), lambda x: x[c])
    sources = hosts.groupBy(F.col("set_id").alias("k")).agg(in_order("label", "pos").alias("sources"))
    summaries = top.groupBy("k").agg(F.array_join(in_order("line", "doc_id"), "\n").alias("summary")).join(sources, "k", "left").withColumnRenamed("k", "set_id")
    pages = digest.html_page(summaries, "Digest").join(sizes.withColumnRenamed("k", "set_id"), "set_id").withColumnRenamed("set_id", "title")
    path = scratch_path(spark, "digest")
    write_pages(pages, path)
    files = spark.read.text(f"{path}/page-*.html", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"page-(\d+)", 1).cast("long").alias("place"), F.md5("value").alias("page"))
    return files


@query(Q.cte(Q.sents("(SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 100 = 0 THEN '. And this last sentence is new today.' ELSE '' END AS text FROM documents)"))
       + "SELECT set_id, sent_idx, set_id % 100 = 0 AS fresh FROM s")
def clusters_reused(spark, d):
    """All documents are clustered, one in a hundred gets another sentence, and all are clustered again: what was made anew the second time."""
    docs = docs_of(spark, d).select(F.col("doc_id").alias("set_id"), "text")
    store = ClusteringStore(scratch_path(spark, "clusterings"), "seeded-7")

    store.clustered_rows(docs, cluster.rows_by_shared_words).write.format("noop").mode("overwrite").save()
    more = F.when(F.col("set_id") % 100 == 0, ". And this last sentence is new today.").otherwise("")
    changed = docs.select("set_id", F.concat(F.coalesce("text", F.lit("")), more).alias("text"))
    return store.clustered_rows(changed, cluster.rows_by_shared_words).select("set_id", "sent_idx", "fresh")
