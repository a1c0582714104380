"""Counts and histograms over alignments, of all or by file (`by`)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.params import ScanParam, is_unmapped
from readloom.operators.regions import label_regions


def each_contig(header: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The header, or its rows for every row of groups. Both are small: a row a contig, and a row a file."""
    if groups is None:
        return header
    return groups.withColumn("__one", F.lit(1)).join(F.broadcast(header.withColumn("__one", F.lit(1))), "__one").drop("__one")


def count_by_contig(aln: DataFrame, header: DataFrame, param: ScanParam | None = None, by: Sequence[str] = (), groups: DataFrame | None = None) -> DataFrame:
    """seqname, seqlength, count of every contig of the header, and the `*` row of unmapped reads if they are included. With
    `by`, for each of groups, which are those of aln if not given."""
    p = param or ScanParam()
    kept = aln.where(p.flag_predicate())
    if p.which:
        kept = label_regions(kept, header, p.which)
    if by and groups is None:
        groups = aln.select(*by).distinct()
    mapped = kept.where(~is_unmapped()).groupBy(*by, "ref_id").agg(F.count("*").alias("count"))
    count = F.coalesce("count", F.lit(0)).cast("long").alias("count")
    out = each_contig(header, groups).join(mapped, [*by, "ref_id"], "left").select(*by, "seqname", F.col("seqlength").cast("long"), count)
    if not p.include_unmapped:
        return out
    lost = kept.where(is_unmapped()).groupBy(*by).agg(F.count("*").alias("count"))
    if by:
        lost = groups.join(lost, [*by], "left")
    return out.unionByName(lost.select(*by, F.lit("*").alias("seqname"), F.lit(None).cast("long").alias("seqlength"), count))


def fragment_sizes(aln: DataFrame, param: ScanParam | None = None, drop_mate_unmapped: bool = True, by: Sequence[str] = (), ordered: bool = True) -> DataFrame:
    """fragment_size, count by absolute template length, rising; 0 is a size like any other."""
    p = param or ScanParam()
    kept = aln.where(p.flag_predicate())
    if drop_mate_unmapped:
        kept = kept.where(F.col("flag").bitwiseAND(8) == 0)
    out = kept.groupBy(*by, F.abs(F.col("isize").cast("long")).alias("fragment_size")).agg(F.count("*").alias("count"))
    return out.orderBy(*by, "fragment_size") if ordered else out


def mapq_dist(aln: DataFrame, param: ScanParam | None = None, by: Sequence[str] = (), ordered: bool = True) -> DataFrame:
    """mapq, count of observed qualities, rising, 255 included."""
    out = aln.where((param or ScanParam()).flag_predicate()).groupBy(*by, "mapq").agg(F.count("*").alias("count"))
    return out.orderBy(*by, "mapq") if ordered else out


def histogram_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, count_a, count_b, diff over the keys of either, a missing side being 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    both = a.select(key, F.col("count").alias("count_a")).join(b.select(key, F.col("count").alias("count_b")), key, "full")
    return both.select(key, zero("count_a").alias("count_a"), zero("count_b").alias("count_b"), (zero("count_a") - zero("count_b")).alias("diff"))
