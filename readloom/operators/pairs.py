"""Mates: the k-th first mate of a name with its k-th second mate, in file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from readloom.functions.params import ScanParam, is_unmapped

FIRST, LAST = 64, 128


def eligible() -> Column:
    """Mapped and paired."""
    return ~is_unmapped() & (F.col("flag").bitwiseAND(1) != 0)


def mate_pairs(aln: DataFrame, order: list[str], fields: list[str], param: ScanParam | None = None, ordered: bool = False, seen: Observation | None = None) -> DataFrame:
    """qname, pair_idx, first_<field>..., last_<field>...; surplus mates are left out. A read that is both is on both sides.

    Reads are dealt by name once; ranks and pairs are made there. ordered: sorted by name, then by pair_idx. seen: receives, when
    the result is run, reads (that pass the filter) and dropped (of these, those that cannot be in a pair)."""
    kept = aln.where((param or ScanParam()).flag_predicate())
    if seen is not None:
        kept = kept.observe(seen, F.count("*").alias("reads"), F.count(F.when(~eligible(), 1)).alias("dropped"))
    own = [f"__o{i}" for i in range(len(order))]
    sides = F.array_compact(F.array(*[F.when(F.col("flag").bitwiseAND(bit) != 0, F.lit(bit)) for bit in (FIRST, LAST)]))
    rows = kept.where(eligible() & F.col("qname").isNotNull()).select("qname", F.explode(sides).alias("__side"), F.struct(*fields).alias("__x"), *[F.col(o).alias(n) for o, n in zip(order, own)])
    rows = rows.repartition("qname").withColumn("pair_idx", F.row_number().over(Window.partitionBy("qname", "__side").orderBy(*own)))
    side = lambda bit: F.first(F.when(F.col("__side") == bit, F.col("__x")), ignorenulls=True)
    both = rows.groupBy("qname", "pair_idx").agg(side(FIRST).alias("__a"), side(LAST).alias("__b")).where("__a is not null and __b is not null")
    out = both.select("qname", "pair_idx", *[F.col(f"__a.{f}").alias(f"first_{f}") for f in fields], *[F.col(f"__b.{f}").alias(f"last_{f}") for f in fields])
    return out.orderBy("qname", "pair_idx") if ordered else out


def dropped_mates(aln: DataFrame, param: ScanParam | None = None) -> DataFrame:
    """dropped: surplus mates over the names that have both."""
    kept = aln.where((param or ScanParam()).flag_predicate() & eligible() & F.col("qname").isNotNull())
    a, b = (F.count(F.when(F.col("flag").bitwiseAND(bit) != 0, 1)) for bit in (FIRST, LAST))
    both = kept.groupBy("qname").agg(a.alias("a"), b.alias("b")).where("a > 0 and b > 0")
    return both.agg(F.coalesce(F.sum(F.abs(F.col("a") - F.col("b"))), F.lit(0)).cast("long").alias("dropped"))
