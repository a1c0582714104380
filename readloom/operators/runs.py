"""Run-length encoding of a column in a given order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FANOUT = 4096
"""Chunks that one task puts in order."""


def _changed(value: Column, window) -> Column:
    """Whether a value differs from the one before it; false for the first."""
    return ((F.row_number().over(window) > 1) & ~value.eqNullSafe(F.lag(value).over(window))).cast("long")


def _joined(parts: DataFrame, over, key: list[str]) -> DataFrame:
    """Rows (first, last, changes) in order, with base: the runs that begin before each, counting the border to it."""
    head, tail = F.col("first"), F.lag("last").over(over)
    border = ((F.row_number().over(over) > 1) & ~head.eqNullSafe(tail)).cast("long")
    step = parts.withColumn("border", border).withColumn("step", F.col("border") + F.col("changes"))
    return step.withColumn("base", F.sum("step").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("changes")).select(*key, "first", "last", "changes", "base", "step")


def run_lengths(df: DataFrame, value: str, order: list[str], chunk: Column, fanout: int = FANOUT) -> DataFrame:
    """run (from 0), value, run_length of maximal runs of equal value. chunk: a whole number that does not fall along the order.

    Sums are taken within chunks, over the chunks of each stretch of `fanout` chunk numbers, and over the stretches, so that
    no task orders more than the last few totals of all rows."""
    own = [f"__o{i}" for i in range(len(order))]
    rows = df.select(chunk.cast("long").alias("__c"), F.col(value).alias("value"), *[F.col(o).alias(n) for o, n in zip(order, own)])
    inside = Window.partitionBy("__c").orderBy(*own)
    marked = rows.withColumn("__new", _changed(F.col("value"), inside))
    marked = marked.withColumn("__k", F.sum("__new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    parts = marked.groupBy("__c", "__k").agg(F.first("value").alias("value"), F.count("*").alias("n"))
    chunks = parts.groupBy("__c").agg(F.min_by("value", "__k").alias("first"), F.max_by("value", "__k").alias("last"), F.max("__k").alias("changes"))
    chunks = chunks.withColumn("__s", F.floor(F.col("__c") / fanout))
    near = _joined(chunks, Window.partitionBy("__s").orderBy("__c"), ["__s", "__c"])
    whole = near.groupBy("__s").agg(F.min_by("first", "__c").alias("first"), F.max_by("last", "__c").alias("last"), F.sum("step").alias("changes"))
    far = _joined(whole, Window.orderBy("__s"), ["__s"]).select("__s", F.col("base").alias("__far"))
    placed = parts.join(near.select("__s", "__c", "base").join(far, "__s").select("__c", (F.col("base") + F.col("__far")).alias("__base")), "__c")
    return placed.groupBy((F.col("__base") + F.col("__k")).alias("run")).agg(F.first("value").alias("value"), F.sum("n").alias("run_length"))
