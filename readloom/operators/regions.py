"""Regions: the first interval that holds a record's start, batches by region, overlap queries.

Points and runs meet intervals in bins of fixed width: both sides are dealt by contig and bin, so that a contig is the work
of many tasks and a row meets only the intervals near it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.params import CHAIN, Interval, intervals, is_unmapped, usable

BIN = 1 << 14
"""Positions of a bin."""


def first_of(regions: Iterable[Interval]) -> list[tuple[str, int, int, str]]:
    """Disjoint (seqname, start, end, label), 1-based closed: each position's first region in the caller's order."""
    out: list[tuple[str, int, int, str]] = []
    by_name: dict[str, list[tuple[int, Interval]]] = {}
    for i, r in enumerate(regions):
        by_name.setdefault(r.seqname, []).append((i, r))
    for name, given in by_name.items():
        given.sort(key=lambda x: x[1].start)
        edges = sorted({p for _, r in given for p in (r.start, r.end + 1)})
        open_: list[tuple[int, int, str]] = []
        at = 0
        for s, e in zip(edges, edges[1:]):
            while at < len(given) and given[at][1].start <= s:
                heapq.heappush(open_, (given[at][0], given[at][1].end, given[at][1].label))
                at += 1
            while open_ and open_[0][1] < s:
                heapq.heappop(open_)
            if open_:
                out.append((name, s, e - 1, open_[0][2]))
    return out


def label_regions(aln: DataFrame, header: DataFrame, regions: Iterable[Interval], chain: int = CHAIN, width: int = BIN) -> DataFrame:
    """Mapped records that start in a region, with which_label: the first such region in the caller's order. If no region
    is usable there is no filter, and the label is `*`. Beyond `chain` regions, they become disjoint pieces, so that a record
    meets at most one by a join and none twice."""
    ready = usable(intervals(regions))
    if not ready:
        return aln.withColumn("which_label", F.lit("*"))
    mapped = aln.where(~is_unmapped())
    if len(ready) <= chain:
        ids = {r["seqname"]: r["ref_id"] for r in header.where(F.col("seqname").isin([r.seqname for r in ready])).select("seqname", "ref_id").collect()}
        known = [r for r in ready if r.seqname in ids]
        if not known:
            return mapped.where(F.lit(False)).withColumn("which_label", F.lit(None).cast("string"))
        tests = [((F.col("ref_id") == ids[r.seqname]) & F.col("pos").between(r.start, r.end), r.label) for r in known]
        label = reduce(lambda acc, t: acc.when(t[0], t[1]), tests[1:], F.when(*tests[0]))
        return mapped.withColumn("which_label", label).where("which_label is not null")
    table = aln.sparkSession.createDataFrame(first_of(ready), "seqname string, __s long, __e long, which_label string").join(header.select(F.col("ref_id").alias("__ref"), "seqname"), "seqname")
    table = table.select("__ref", "__s", "__e", "which_label", F.explode(F.sequence(_bin("__s", width), _bin("__e", width))).alias("__bin"))
    near = mapped.withColumn("__at", _bin("pos", width))
    hit = near.join(table, (F.col("ref_id") == F.col("__ref")) & (F.col("__at") == F.col("__bin")) & F.col("pos").between(F.col("__s"), F.col("__e")))
    return hit.select(*aln.columns, "which_label")


def _bin(c: str | Column, width: int) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / width)


def region_batches(aln: DataFrame, header: DataFrame, regions: Iterable[Interval]) -> DataFrame:
    """batch, which_label and the records of each region as given, empty batches as one row of nulls. Regions of one label
    repeat its records."""
    given = intervals(regions)
    labels = aln.sparkSession.createDataFrame([(i, r.label) for i, r in enumerate(given)], "batch int, which_label string")
    return labels.join(label_regions(aln, header, given), "which_label", "left")


def overlap_query(runs: DataFrame, queries: DataFrame, width: int = BIN) -> DataFrame:
    """Runs (ref_id, start, end, value) that overlap queries (query, ref_id, qs, qe), 0-based half-open. A pair meets in every bin
    that both touch and is taken in the first of them."""
    q = queries.withColumnRenamed("ref_id", "__ref").withColumn("__from", _bin("qs", width))
    q = q.withColumn("__qbin", F.explode(F.sequence("__from", _bin(F.greatest(F.col("qe") - 1, F.col("qs")), width))))
    r = runs.where("start < end").withColumn("__first", _bin("start", width))
    r = r.withColumn("__bin", F.explode(F.sequence("__first", _bin(F.col("end") - 1, width))))
    same = (F.col("ref_id") == F.col("__ref")) & (F.col("__bin") == F.col("__qbin")) & (F.col("__bin") == F.greatest("__first", "__from"))
    return r.join(q, same & (F.col("end") > F.col("qs")) & (F.col("start") < F.col("qe"))).drop("__ref", "__from", "__qbin", "__first", "__bin")
