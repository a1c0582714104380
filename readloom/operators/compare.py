"""Comparing and counting results of any shape."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_records(result: DataFrame | Mapping[str, DataFrame]) -> int:
    """The rows of a result, or of all results of several files."""
    return sum(map(count_records, result.values())) if isinstance(result, Mapping) else result.count()


def unequal_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, in any order, that a and b have not equally often, with the surplus of a. Nulls are equal, and columns go by name."""
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError(f"different columns: {sorted(set(a.columns) ^ set(b.columns))}")
    sides = a.withColumn("__n", F.lit(1)).unionByName(b.withColumn("__n", F.lit(-1)))
    return sides.groupBy(*a.columns).agg(F.sum("__n").alias("surplus")).where("surplus <> 0")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return unequal_rows(a, b).isEmpty()
