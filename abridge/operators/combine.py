"""Several measures into one. `measures` are (set_id, i, j, s) over the same dense pairs, or sparse with 0 left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abridge.operators.measures import rescaled


def stacked(measures: list[DataFrame]) -> DataFrame:
    """(set_id, matrix_id, i, j, s) of all measures."""
    return reduce(DataFrame.unionByName, [m.select("set_id", F.lit(k).alias("matrix_id"), "i", "j", "s") for k, m in enumerate(measures)])


def _cells(stack: DataFrame):
    return stack.groupBy("set_id", "i", "j")


def product(stack: DataFrame, n: int, scale: bool = True) -> DataFrame:
    """Element-wise product; a cell that a measure lacks is 0. Scaled to 0..1 in each set, unless it is one measure alone."""
    values = F.transform(F.sort_array(F.collect_list(F.struct("matrix_id", "s"))), lambda c: c["s"])
    out = _cells(stack).agg(F.when(F.count("*") == n, F.aggregate(values, F.lit(1.0), lambda t, s: t * s)).otherwise(0.0).alias("s"))
    return rescaled(out) if scale and n > 1 else out


def average(stack: DataFrame, n: int) -> DataFrame:
    return _cells(stack).agg((F.sum("s") / n).alias("s"))


def weighted_average(stack: DataFrame, weights: DataFrame, n: int, step: int = 0) -> DataFrame:
    """Weights are (step, matrix_id, w); a matrix without a weight in this step counts 1 / n."""
    now = weights.where(F.col("step") == step).select("matrix_id", "w")
    joined = stack.join(F.broadcast(now), "matrix_id", "left")  # a row for each matrix
    return _cells(joined).agg(F.sum(F.col("s") * F.coalesce("w", F.lit(1.0 / n))).alias("s"))


def by_largest(pairs: DataFrame) -> DataFrame:
    """Divided by the largest value of the set; all 0 stays 0."""
    top = pairs.groupBy("set_id").agg(F.max("s").alias("top"))
    return pairs.join(top, "set_id").withColumn("s", F.when(F.col("top") > 0, F.try_divide("s", "top")).otherwise(0.0)).drop("top")


def lp_norm(stack: DataFrame, p: int) -> DataFrame:
    return by_largest(_cells(stack).agg(F.pow(F.sum(F.pow("s", F.lit(float(p)))), F.lit(1.0 / p)).alias("s")))


def largest(stack: DataFrame) -> DataFrame:
    return _cells(stack).agg(F.max("s").alias("s"))


def smallest(stack: DataFrame, n: int) -> DataFrame:
    """A cell that a measure lacks is 0, so the least is at most 0 there."""
    return _cells(stack).agg(F.when(F.count("*") == n, F.min("s")).otherwise(F.least(F.min("s"), F.lit(0.0))).alias("s"))


def combined(stack: DataFrame, n: int, how: str = "mult") -> DataFrame:
    if how == "mult":
        return product(stack, n)
    if how == "avg":
        return average(stack, n)
    if how in ("l2", "l3", "l4", "l100"):
        return lp_norm(stack, int(how[1:]))
    return largest(stack) if how == "max" else smallest(stack, n)
