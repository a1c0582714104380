"""Line dedup by distinct-site spread.

Every line (without spaces, tabs and carriage returns at its ends) counts in how many distinct sites it occurs: a
HyperLogLog sketch per 64-bit line hash, built where the rows are and merged by aggregation, so a line of a third of all
rows costs one sketch a task. Estimates within BAND of the threshold are replaced by exact distinct counts. A line of
min_sites sites or more is cross-site boilerplate: it goes everywhere but at its first place (least doc_id, then
version of the text, then position), so that its content is not lost.

Up to LITERAL boilerplate lines, texts are filtered where they are, by a constant set of hashes, and only the few documents
that hold a first place are looked up. Beyond that, the hashes that each document loses are gathered from exploded lines,
and documents meet them by a join. Both give the same rows.

Null texts stay null and have no line; lines without a visible character are never counted or removed. A null site
counts for no line. Rows of one id and different texts are different documents. Rows without id come after all others;
those of equal texts are one document. Repeated rows count as one site each time and keep the same lines. An empty table gives
an empty result. All columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import bounded, cut, version

MIN_SITES, LG_K, BAND, LITERAL = 10, 12, 0.25, 10_000
"""Sites of boilerplate; sketch size; how far from the threshold counts are exact; lines that a plan holds as constants."""
LAST = (1 << 63) - 1


def bare(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def _lines(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(LAST)).alias("id"), version(text_col).alias("ver"), *more, F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    return rows.where(bare(F.col("line")) != "").withColumn("key", F.xxhash64(bare(F.col("line")))).drop("line")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", lg_k: int = LG_K) -> DataFrame:
    """key (line hash), first (id, ver, pos) of every line of min_sites distinct sites or more."""
    lines = _lines(docs, id_col, text_col, F.col(site_col).cast("string").alias("site"))
    spread = lines.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"), F.min(F.struct("id", "ver", "pos")).alias("first"))
    wide = cut(spread.where(F.col("sites") >= min_sites * (1 - BAND)), "spread")
    near = wide.where(F.col("sites") <= min_sites * (1 + BAND))
    exact = lines.join(bounded(near.select("key")), "key", "left_semi").groupBy("key").agg(F.count_distinct("site").alias("exact")).where(F.col("exact") >= min_sites)
    return wide.where(F.col("sites") > min_sites * (1 + BAND)).select("key", "first").unionByName(near.join(exact, "key").select("key", "first"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", removed: str = "lines_removed", literal: int = LITERAL) -> DataFrame:
    """docs with boilerplate lines taken from the text, and how many."""
    bad = cut(boilerplate(docs, min_sites, id_col, text_col, site_col), "boilerplate")
    keys = [r[0] for r in bad.select("key").limit(literal + 1).collect()]
    kept_places = bad.groupBy(F.col("first.id").alias("__id"), F.col("first.ver").alias("__ver")).agg(F.collect_list("first.pos").alias("__held"))
    row = F.struct(F.coalesce(F.col(id_col), F.lit(LAST)).alias("id"), version(text_col).alias("ver"))
    if len(keys) <= literal:
        held = F.broadcast(kept_places)
        lost = lambda x: F.xxhash64(bare(x)).isin(keys)
    else:
        hits = _lines(docs, id_col, text_col).join(bounded(bad.select("key")), "key").groupBy(F.col("id").alias("__id"), F.col("ver").alias("__ver")).agg(F.collect_set("key").alias("__gone"))
        held = hits.join(kept_places, ["__id", "__ver"], "left")
        lost = lambda x: F.coalesce(F.array_contains("__gone", F.xxhash64(bare(x))), F.lit(False))
    wide = docs.withColumn("__row", row).join(held, (F.col("__row.id") == F.col("__id")) & (F.col("__row.ver") == F.col("__ver")), "left")
    wide = wide.withColumn("__parts", F.split(F.col(text_col), "\n"))
    wide = wide.withColumn("__kept", F.filter("__parts", lambda x, i: (bare(x) == "") | ~lost(x) | F.coalesce(F.array_contains("__held", i), F.lit(False))))
    wide = wide.withColumn("__n", F.when(F.col("__parts").isNull(), 0).otherwise(F.size("__parts") - F.size("__kept")).cast("int"))
    text = F.when(F.col("__n") > 0, F.array_join("__kept", "\n")).otherwise(F.col(text_col))
    return wide.select(*[(text if c == text_col else F.col(c)).alias(c) for c in docs.columns], F.col("__n").alias(removed))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return remove_boilerplate(docs).select("doc_id", "text", "lines_removed")


OP8_SQL = """
WITH d AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
l AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM d),
b AS (SELECT bare, min({'id': doc_id, 'pos': pos}) AS first FROM l WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 10),
k AS (SELECT l.doc_id, l.line, l.pos, b.bare IS NULL OR (b.first.id = l.doc_id AND b.first.pos = l.pos) AS kept FROM l LEFT JOIN b ON l.bare = b.bare)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE kept), '') AS text, CAST(count(*) FILTER (WHERE NOT kept) AS INTEGER) AS lines_removed
FROM k GROUP BY doc_id
"""
