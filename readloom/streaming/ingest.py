"""Alignments that arrive as Parquet files in a landing folder, kept as running histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from readloom.functions.params import ScanParam
from readloom.operators import aggregate


def alignment_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def running_histogram(stream: DataFrame, kind: str, param: ScanParam | None = None) -> DataFrame:
    """mapq or fragment-size counts of all that has arrived, for output mode `complete`."""
    return {"mapq": aggregate.mapq_dist, "fragment_sizes": aggregate.fragment_sizes}[kind](stream, param)
