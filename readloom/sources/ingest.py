"""A Parquet store of alignments, partitioned by contig and sorted by position, so that regions prune files and row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.params import FLAG_BITS

FLAGS = {"is_unmapped": "isUnmappedQuery", "is_reverse": "isMinusStrand", "is_secondary": "isSecondaryAlignment", "is_duplicate": "isDuplicate", "is_qc_fail": "isNotPassingQualityControls"}


def with_flag_columns(aln: DataFrame) -> DataFrame:
    """aln with the usual flag tests as columns, which data sources can filter by."""
    return aln.withColumns({c: F.col("flag").bitwiseAND(FLAG_BITS[b]) != 0 for c, b in FLAGS.items()})


def write_store(aln: DataFrame, path: str, span: int = 1 << 24, unplaced_parts: int = 64) -> None:
    """Rows are dealt by contig and stretches of `span` positions, so that a large contig is several tasks and files; unplaced reads,
    which may be many, by a hash of what tells them apart."""
    own = [c for c in ("_ord", "qname", "flag", "mapq") if c in aln.columns]
    stretch = F.when(F.col("ref_id") < 0, F.pmod(F.xxhash64(*own), F.lit(unplaced_parts))).otherwise(F.floor(F.col("pos") / span))
    dealt = with_flag_columns(aln).repartition("ref_id", stretch)
    dealt.sortWithinPartitions("ref_id", "pos").write.mode("overwrite").partitionBy("ref_id").parquet(path)
