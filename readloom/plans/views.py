"""Alignment-shaped views over the driver's tables. The expressions are SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HEADER = {"ref_id": "n_nationkey", "seqname": "n_name", "seqlength": "1500 + 25 * n_nationkey"}
ALIGNMENTS = {
    "qname": "concat('r', cast(l_orderkey as string))",
    "flag": """1 + (case when l_linenumber % 2 = 1 then 64 else 128 end) + (case when l_linestatus = 'F' then 16 else 0 end) + (case when l_partkey % 17 = 0 then 4 else 0 end)
      + (case when l_suppkey % 11 = 0 then 8 else 0 end) + (case when l_linenumber = 7 then 256 else 0 end) + (case when l_partkey % 23 = 0 then 512 else 0 end) + (case when l_returnflag = 'R' then 1024 else 0 end)""",
    "ref_id": "cast(case when l_suppkey % 29 = 0 then -1 else l_suppkey % 25 end as int)",
    "pos": "cast(1 + l_partkey % 2100 as int)",
    "mapq": "cast(floor(l_quantity) as int)",
    "cigar": "case l_linenumber when 1 then '50M' when 2 then '20M500N30M' when 3 then '10S40M' when 4 then '25M2I23M' when 5 then '25M3D25M' when 6 then '5H30=2X18=' else '40M10P10M' end",
    "isize": "cast((case when l_linenumber % 2 = 1 then 1 else -1 end) * (cast(floor(l_extendedprice) as bigint) % 1000) as int)",
    "mate_ref_id": "cast((l_suppkey + l_linenumber) % 27 as int)",
    "mpos": "cast(case when l_orderkey % 19 = 0 then 0 else 1 + l_partkey % 2000 end as int)",
    "file": "concat('file_', l_returnflag)",
    "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey", "l_extendedprice": "l_extendedprice",
}
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
"""Columns that give file order; together they are unique."""


def header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr(*[f"{e} as {c}" for c, e in HEADER.items()])


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*[f"{e} as {c}" for c, e in ALIGNMENTS.items()])


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, qwidth, seq and qual as packed bytes, from documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.selectExpr("doc_id", "31 as qwidth", "unhex(md5(cast(text as binary))) as seq", "unhex(md5(cast(lang as binary))) as qual")


def _select(columns: dict[str, str], table: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table}"


WITH = f"WITH hdr AS ({_select(HEADER, 'nation')}), aln AS ({_select(ALIGNMENTS, 'lineitem')})"
