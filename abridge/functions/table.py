"""Summaries from SQL: `SELECT * FROM summarize(TABLE(SELECT doc_id, abridge_sentences(text) AS sents FROM documents) PARTITION BY (doc_id), 300, 'WORDS')`.

`abridge_sentences` is an expression that Spark plans like any other; `summarize` is a table function with a table argument, so Spark shuffles by set
and each set is chosen from in one call, as `select.select_documents` does. The result has the set's column, of its own name and type, and `summary`.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from abridge.config import Config

_SPLIT = r"split(coalesce(body, ''), '(?<=[.!?])\\W+')"
_SENTENCES = rf"""filter(transform(filter(transform({_SPLIT}, s -> regexp_replace(replace(s, '\n', ' '), '^\\s+|\\s+$', '')), s -> s <> ''),
  s -> named_struct('text', s, 'tokens', filter(split(s, '\\s+'), t -> t <> ''), 'words', filter(transform(filter(split(s, '\\s+'), t -> t <> ''), t -> lower(regexp_replace(t, '[^\\p{{L}}\\p{{Nd}}]', ''))), w -> w <> ''))),
  s -> size(s.tokens) >= least)"""


def _summary(sents: list, config: Config, stop: frozenset[str]) -> str:
    """Sentences of one set, (text, tokens, words) each, summarised in the order in which they stand."""
    from abridge.operators.select import clusters_of, cosine_matrix, kernel_select, word_cells

    words = [s["words"] for s in sents]
    w = cosine_matrix(*word_cells(words, stop, config.bigrams, config.idf_mode == "floor", config.zero_idf_as_one), len(words))
    size = {"WORDS": lambda s: len(s["tokens"]), "SENTENCES": lambda s: 1, "CHARACTERS": lambda s: len(s["text"].encode()) + 1}[config.unit]
    found = kernel_select(w, clusters_of(w, config), np.array([size(s) for s in sents], float), np.array([len(s["text"]) for s in sents], float), config)
    return "\n".join(" ".join(sents[k]["tokens"]) for k in sorted(k for k, _ in found))


def register_summaries(spark: SparkSession, config: Config = Config(), stop: tuple[str, ...] = ()) -> None:
    """Make `abridge_sentences` and `summarize` known in a session. Length and unit are arguments; all else is of `config`."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION abridge_sentences(body STRING, least INT DEFAULT 4) RETURNS ARRAY<STRUCT<text: STRING, tokens: ARRAY<STRING>, words: ARRAY<STRING>>> RETURN {_SENTENCES}")
    listed = frozenset(stop)

    @udtf
    class Summarize:
        @staticmethod
        def analyze(table: AnalyzeArgument, length: AnalyzeArgument, unit: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable or "sents" not in table.dataType.fieldNames():
                raise ValueError("summarize takes a table with the column sents, as abridge_sentences makes it, partitioned by its set")
            if unit.value not in ("WORDS", "SENTENCES", "CHARACTERS") or not isinstance(length.value, int):
                raise ValueError("summarize takes a length and WORDS, SENTENCES or CHARACTERS as constants")
            key = next(f for f in table.dataType.fields if f.name != "sents")
            return AnalyzeResult(StructType().add(key.name, key.dataType).add("summary", StringType()))

        def __init__(self):
            self.key, self.sents, self.config = None, [], None

        def eval(self, row, length: int, unit: str):
            data = row.asDict()
            self.sents += data.pop("sents") or []
            self.key, self.config = next(iter(data.values())), replace(config, length=length, unit=unit)

        def terminate(self):
            if self.sents:
                yield self.key, _summary(self.sents, self.config, listed)

    spark.udtf.register("summarize", Summarize)
