"""From raw documents to packed sequences, in five stages; each works on all that its predecessor kept.

A stage takes and returns the columns of documents; the last returns pieces placed in sequences. Rows without id are kept by
every stage that decides by id. Rows of one id and different texts are different documents, and each goes or stays by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import langid, lines, packing, simhash, substrings
from readloom.llm.common import bounded, cut, version


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (no letter) go; lang becomes the prediction."""
    model = langid.fit(docs, ~langid.held_out())
    found = langid.predict(docs, model, pred="__pred", score="__score").where(F.col("__pred") != langid.UNKNOWN)
    return found.withColumn("lang", F.col("__pred")).drop("__pred", "__score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go, but for their first place, and documents that held nothing else."""
    found = lines.remove_boilerplate(docs, removed="__removed")
    return found.where((F.col("__removed") == 0) | (F.trim(F.col("text"), F.lit(" \t\r\n")) != "")).drop("__removed")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id; of an id with several texts, that of the least version."""
    groups = cut(simhash.near_dedup(docs.select("doc_id", "text")).where("doc_id is not null"), "groups")
    own = groups.where("doc_id = component_id")
    several = cut(own.groupBy("root").agg(F.min("version").alias("kept"), F.count("*").alias("n")).where("n > 1"), "several")
    later = own.join(bounded(several), "root").where("version <> kept")
    gone = cut(groups.where("doc_id <> component_id").unionByName(later, True).select(F.col("doc_id").alias("__id"), F.col("version").alias("__version")).distinct(), "copies")

    def of(named: DataFrame):
        return bounded(named), (F.col("doc_id") == F.col("__id")) & (version("text") == F.col("__version"))

    rest = docs.join(*of(gone), "left_anti")
    if several.isEmpty():
        return rest
    repeated = cut(own.groupBy(F.col("doc_id").alias("__id"), F.col("version").alias("__version")).count().where("count > 1").select("__id", "__version"), "repeated")
    once = rest.join(*of(repeated), "left_semi").withColumn("__version", version("text")).dropDuplicates(["doc_id", "__version"]).drop("__version")
    return rest.join(*of(repeated), "left_anti").unionByName(once)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go, and documents that held nothing else."""
    return substrings.remove_passages(docs, cut(substrings.passages(docs), "passages"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("best-fit packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
