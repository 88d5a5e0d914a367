"""Proportional stratified interleaving: shards that each hold the mixture of sources. [native]

Rows are shuffled within their source by a seeded hash; row r of a source of n gets the fraction
(r - h) / n, h a seeded hash of the source from 0 to 1. Sorted by that fraction, the sources interleave in proportion, and a cut into equal runs
gives shards whose row counts differ by one at most. (With 1/2 for h, many sources of one row each would all meet at one place.)

Neither rank is taken in one window over a source or over the table: rows fall into BUCKETS hash
prefixes (then ranges of the fraction), buckets are counted with partial sums, and only the counts are
added up in order. A source with a third of all rows is spread over all its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from abridge.llm.common import stored

#: Hash prefixes of a source, and ranges of the fraction.
PREFIX, BUCKETS = 3, 16**3


def shuffle_key(seed: int, id_col: str, text_col: str) -> str:
    """Rows without an id are told apart by their texts."""
    text = f"coalesce(`{text_col}`, '')"
    return f"md5(concat('{seed}:', coalesce(cast(`{id_col}` as string), concat('null:', crc32({text}), ':', octet_length({text})))))"


def stratified_shards(docs: DataFrame, shards: int = 40, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, *keep) of every row.

    size is the text's UTF-8 bytes plus 16, text_crc32 that of its UTF-8 bytes; a null text counts as empty.
    The law is `rows`: shards 0 to `shards` - 1 differ by one row at most; slot counts from 0 in each.
    A null source is a source of its own; rows without an id have their text's checksum and size for it. Rows that repeat each have a slot. An empty table gives no rows. `keep` names columns of
    `docs` that travel along.
    """
    rows = docs.select(
        F.col(id_col).alias("__id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").__add__(16).alias("__size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("__crc"),
        F.struct(F.col(source_col).cast("string")).alias("__src"),
        F.expr(shuffle_key(seed, id_col, text_col)).alias("__key"),
        (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(source_col).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)).alias("__h"),
        *keep,
    ).withColumn("__b", F.substring("__key", 1, PREFIX))
    parts = rows.groupBy("__src", "__b").agg(F.count("*").alias("k"))
    in_order = W.partitionBy("__src").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        "__src", "__b",
        F.coalesce(F.sum("k").over(in_order), F.lit(0)).alias("before"),
        F.sum("k").over(W.partitionBy("__src")).alias("n"),
    )
    within = W.partitionBy("__src", "__b").orderBy("__key", "__id", "__crc", "__size")
    ranked = rows.join(parts, ["__src", "__b"]).withColumn("r", F.row_number().over(within) + F.col("before"))
    ranked = ranked.withColumn("__frac", F.expr("(r - __h) / n")).drop("before", "n", "r", "__b", "__h")
    ranked = stored(ranked.withColumn("__g", F.floor(F.col("__frac") * BUCKETS).cast("int")), "ranked")

    ranges = ranked.groupBy("__g").agg(F.count("*").alias("k"))
    whole = W.partitionBy()
    ranges = ranges.select(  # BUCKETS rows at most
        "__g",
        F.coalesce(F.sum("k").over(whole.orderBy("__g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("k").over(whole).alias("n"),
    )
    within = W.partitionBy("__g").orderBy("__frac", "__src", "__key", "__id", "__crc", "__size")
    placed = ranked.join(F.broadcast(ranges), "__g").withColumn("at", F.row_number().over(within) + F.col("before") - 1)
    placed = placed.withColumn("shard", F.expr(f"at * {shards} div n"))
    return placed.select(
        F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.expr(f"at - (shard * n + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *keep,
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 17, per_shard: int = 1, **columns: str) -> None:
    """Write all columns of `docs` below path/shard=N, in slot order, as `per_shard` files or so each."""
    named = {"id_col": "doc_id", "text_col": "text", "source_col": "source"} | columns
    packed = docs.select(*named.values(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    placed = stratified_shards(packed, shards, seed, keep=("__row",), **named)
    rows = placed.select("shard", "slot", "__row.*") if not {"shard", "slot"} & set(docs.columns) else placed.select("shard", "slot", F.col("__row").alias("row"))
    rows.repartitionByRange(shards * per_shard, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
