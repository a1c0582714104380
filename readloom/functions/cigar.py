"""CIGAR text: parsing, formatting, and the blocks that an alignment covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COVERS, SKIPS = ["M", "=", "X", "D"], ["N"]


def parse(cigar: Column) -> Column:
    """array<struct<len:int, op:string>>; empty for a missing CIGAR."""
    parts = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit("([0-9]+[MIDNSHPX=])"), F.lit(1))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, "^([0-9]+)", 1).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))


def to_text(ops: Column) -> Column:
    """The text of a parsed CIGAR; none is an empty string."""
    return F.array_join(F.transform(ops, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def relative_blocks(ops: Column) -> Column:
    """array<struct<s:long, e:long>> of covered stretches, from the alignment's start. Deletions cover, skips only advance."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        n = x["len"].cast("long")
        covers = x["op"].isin(COVERS)
        block = F.array(F.struct(acc["at"].alias("s"), (acc["at"] + n).alias("e")))
        return F.struct(F.when(covers | x["op"].isin(SKIPS), acc["at"] + n).otherwise(acc["at"]).alias("at"), F.when(covers, F.concat(acc["out"], block)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ops, zero, step, lambda acc: acc["out"])


def covered(cigar: Column) -> Column:
    """relative_blocks of a CIGAR's text; one match from end to end, as most reads have, needs no parsing."""
    whole = F.array(F.struct(F.lit(0).cast("long").alias("s"), F.substring(cigar, F.lit(1), F.length(cigar) - 1).cast("long").alias("e")))
    return F.when(F.translate(cigar, "0123456789", "") == "M", whole).otherwise(relative_blocks(parse(cigar)))


def blocks(aln: DataFrame) -> DataFrame:
    """aln with s, e: a row per covered stretch, 0-based half-open. Each read is walked where it is; there is no join by CIGAR,
    of which one may be that of most reads."""
    found = aln.select("*", F.explode(covered(F.col("cigar"))).alias("__b"))
    return found.select(*aln.columns, (F.col("pos") - 1 + F.col("__b.s")).alias("s"), (F.col("pos") - 1 + F.col("__b.e")).alias("e"))
