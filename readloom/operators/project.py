"""Projection: fields, strand, names of contigs, mates, alignments only.

An alignment table has ref_id and mate_ref_id (0-based, -1 for none) and pos (1-based); a header has ref_id, seqname, seqlength.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.params import ScanParam, is_unmapped
from readloom.operators.regions import label_regions

IMPLIED = {"alignments": ("rname", "pos", "cigar", "strand"), "pairs": ("rname", "pos", "cigar", "strand", "qname", "flag")}


def strand(flag: str = "flag", ref_id: str = "ref_id") -> Column:
    return F.when(is_unmapped(flag, ref_id), "*").when(F.col(flag).bitwiseAND(16) != 0, "-").otherwise("+")


def with_names(aln: DataFrame, header: DataFrame, id_col: str = "ref_id", out: str = "rname") -> DataFrame:
    """aln with the contig's name, null where the header has no such contig. A header is a few thousand rows; Spark broadcasts
    it by its size."""
    names = header.select(F.col("ref_id").alias("__ref"), F.col("seqname").alias(out))
    return aln.join(names, F.col(id_col) == F.col("__ref"), "left").drop("__ref")


def with_fields(aln: DataFrame, header: DataFrame) -> DataFrame:
    """All derived fields: rname and pos are null for unmapped reads, mates' by the header and their position alone."""
    lost = is_unmapped()
    out = with_names(aln, header)
    out = out.withColumns({"rname": F.when(~lost, F.col("rname")), "strand": strand(), "pos": F.when(~lost, F.col("pos"))})
    if "mate_ref_id" in aln.columns:
        out = with_names(out, header, "mate_ref_id", "mrnm").withColumn("mpos", F.when(F.col("mpos") >= 1, F.col("mpos")))
    return out


def scan(aln: DataFrame, header: DataFrame, param: ScanParam | None = None) -> DataFrame:
    """Filter, then project: fields in the order asked for, tags, and which_label where regions are given."""
    p = param or ScanParam()
    kept = aln.where(p.flag_predicate())
    if not p.include_unmapped:
        kept = kept.where(~is_unmapped())
    label = []
    if p.which:
        kept, label = label_regions(kept, header, p.which), ["which_label"]
    return with_fields(kept, header).select(*p.fields, *p.tags, *label)


def mapped_alignments(aln: DataFrame, header: DataFrame, param: ScanParam | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Mapped records with a contig of the header: the implied fields, then the extra ones in their order."""
    p = param or ScanParam()
    names = list(dict.fromkeys([*IMPLIED["alignments"], *extra]))
    full = with_fields(aln.where(p.flag_predicate() & ~is_unmapped()), header)
    return full.where("rname is not null and pos is not null").select(*names)
