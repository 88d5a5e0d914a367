"""Summaries from the command line: python -m abridge FILE... [options], or --m MATRIX... --s SENTENCES."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from abridge import api
from abridge.operators import render
from abridge.sources import lists

#: Flags of earlier implementations as parameters.
FLAGS = {
    "MOD_COST_WEIGHT": {"cost_weight": True}, "MOD_SINGLETON": {"singleton": True}, "MOD_STRICT_LENGTH": {"strict_length": True}, "MOD_BIGRAMS": {"bigrams": True},
    "MOD_PRUNE": {"prune": 0.4}, "MOD_PRONOUNS": {"pronouns": ("he", "she", "they")}, "MOD_R1SUPER": {"clusterings": "each", "mean_diversity": True},
    "MOD_MATRIX_MULT": {"aggregate": "mult"}, "MOD_MATRIX_MAX": {"aggregate": "max"}, "MOD_MATRIX_MIN": {"aggregate": "min"},
    "MOD_MATRIX_L2": {"aggregate": "l2"}, "MOD_MATRIX_L3": {"aggregate": "l3"}, "MOD_MATRIX_L4": {"aggregate": "l4"}, "MOD_MATRIX_L100": {"aggregate": "l100"},
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="abridge", description=__doc__)
    p.add_argument("files", nargs="*", help="documents, or matrices with --m")
    p.add_argument("--document-file", action="append", default=[], help="a document or a directory of them")
    p.add_argument("--m", action="store_true", help="the files are similarity matrices")
    p.add_argument("--matrix-file", action="append", default=[])
    p.add_argument("--s", metavar="SENTENCES", help="one sentence a line, for matrices")
    p.add_argument("--weights-file", help="weights of the matrices for each step")
    p.add_argument("--clustering-file", help="a cluster number for each sentence")
    p.add_argument("--spl", action="store_true", help="one sentence a line")
    p.add_argument("--anaphora-resolution-simple", action="store_true")
    p.add_argument("--no-tfidf", action="store_true")
    p.add_argument("--no-sentiment", action="store_true")
    p.add_argument("--no-w2v", action="store_true")
    p.add_argument("--w2v-file")
    p.add_argument("--stopwords-file")
    p.add_argument("--language", help="stop words of Spark's own for a language, if no file is named")
    p.add_argument("--idf-of-sentences", action="store_true", help="count sentences, not documents, for idfs")
    p.add_argument("--positive-words-file")
    p.add_argument("--negative-words-file")
    p.add_argument("--male-names-file")
    p.add_argument("--female-names-file")
    p.add_argument("--word-clusters-file")
    p.add_argument("--collection-for-idfs", help="a directory of documents")
    p.add_argument("--folders-for-idfs", help="a directory of folders that hold a file `sentences`")
    p.add_argument("--input-limit", type=int)
    p.add_argument("--summary-length", type=int, default=300)
    p.add_argument("--summary-length-unit", choices=("WORDS", "SENTENCES", "CHARACTERS"), default="WORDS")
    p.add_argument("--nb-sentences", type=int)
    p.add_argument("--nb-words", type=int)
    p.add_argument("--nb-characters", type=int)
    p.add_argument("--lambda", type=float, dest="diversity", default=6.0)
    p.add_argument("--stemmer", choices=("none", "porter", "porter2"), default="porter2")
    p.add_argument("--disable-bigrams", action="store_true")
    p.add_argument("--use-aggregate-for-clustering", action="store_true")
    p.add_argument("--flag", action="append", choices=sorted(FLAGS), default=[])
    p.add_argument("--numerical", action="store_true", help="numbers of sentences instead of their text")
    p.add_argument("--print-as-text", action="store_true", help="sentences in order of choice")
    p.add_argument("--quiet", action="store_true")
    return p


def config_of(args: argparse.Namespace) -> api.Config:
    length, unit = args.summary_length, args.summary_length_unit
    for name in ("sentences", "words", "characters"):
        if (given := getattr(args, f"nb_{name}")) is not None:
            length, unit = given, name.upper()
    config = replace(
        api.SUMMARY, length=length, unit=unit, diversity=args.diversity, bigrams=not args.disable_bigrams, stemmer=args.stemmer, use_tfidf=not args.no_tfidf, use_sentiment=not args.no_sentiment,
        use_embeddings=not args.no_w2v, input_limit=args.input_limit, cluster_on_aggregate=args.use_aggregate_for_clustering, resolve_pronouns=args.anaphora_resolution_simple,
        idf_unit="sentences" if args.idf_of_sentences else "documents",
    )
    for flag in args.flag:
        config = replace(config, **FLAGS[flag])
    return config


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    """What the command prints."""
    config = config_of(args)
    side = lists.from_files(
        spark, args.stopwords_file, args.positive_words_file, args.negative_words_file, args.male_names_file, args.female_names_file, args.word_clusters_file, args.collection_for_idfs,
        args.folders_for_idfs, None if args.no_w2v else args.w2v_file, args.language,
    )
    matrices = args.matrix_file + (args.files if args.m else [])
    if matrices:
        if not args.s:
            raise SystemExit("matrices need a file of sentences (--s)")
        chosen = api.summarize_matrices(spark, matrices, args.s, config, args.weights_file, args.clustering_file, side)
        sents = api.readers.sentence_lines(spark, args.s)
    else:
        files = args.files + args.document_file
        if not files:
            raise SystemExit("nothing to summarise")
        docs = api.readers.text_documents(spark, files)
        chosen, sents = api.choose(docs, config, "set_id", "text", "doc_id", side, not args.spl)
    if args.numerical:
        rows = render.summary_numbers(chosen).collect()
        return rows[0]["numbers"] if rows else ""
    rows = render.summary_text(chosen, sents, "step" if args.print_as_text else "sent_idx").collect()
    return rows[0]["summary"] if rows else ""


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("abridge").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if args.quiet:
        spark.sparkContext.setLogLevel("OFF")
    print(run(spark, args))


if __name__ == "__main__":
    main()
