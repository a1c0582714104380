"""Interval arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_length(s0: Column, e0: Column, s1: Column, e1: Column) -> Column:
    """Bases that two half-open intervals share."""
    return F.greatest(F.lit(0), F.least(e0, e1) - F.greatest(s0, s1))
