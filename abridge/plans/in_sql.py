"""Summaries by a query in SQL."""

from abridge.config import Config
from abridge.functions.table import register_summaries
from abridge.plans.catalog import ORACLE_SQL, docs_of, query
from abridge.plans.words import STOP


@query(ORACLE_SQL["flagship"])
def summarize_in_sql(spark, d):
    """`flagship` as a user of SQL writes it."""
    register_summaries(spark, Config(singleton=False), STOP)
    return spark.sql(
        "SELECT doc_id AS set_id, summary FROM summarize(TABLE(SELECT doc_id, abridge_sentences(text) AS sents FROM {docs}) PARTITION BY (doc_id), 3, 'SENTENCES')",
        docs=docs_of(spark, d),
    )
