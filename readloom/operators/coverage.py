"""Per-base coverage as maximal runs, and what is computed from runs.

Runs are (ref_id, seqname, start, end, value), 0-based half-open. Covered stretches become +1 and -1 events summed per
position; prefix sums are taken in two levels, within bins of `bin_size` positions and over the bins' totals, so that
one contig is the work of many tasks. With `by`, all is done for each file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.cigar import blocks
from readloom.functions.params import ScanParam
from readloom.operators.aggregate import each_contig

BIN = 1 << 18


def cigar_blocks(aln: DataFrame, header: DataFrame, param: ScanParam | None = None, by: Sequence[str] = ()) -> DataFrame:
    """ref_id, s, e: stretches that mapped reads cover, within the contig."""
    p = param or ScanParam()
    kept = aln.where((F.col("ref_id") >= 0) & (F.col("flag").bitwiseAND(4) == 0) & p.flag_predicate())
    length = header.select(F.col("ref_id").alias("__ref"), F.col("seqlength").cast("long").alias("__len"))
    found = blocks(kept.select(*by, "ref_id", "pos", "cigar").join(length, F.col("ref_id") == F.col("__ref")))
    clamp = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.col("__len"))
    return found.select(*by, "ref_id", clamp("s").alias("s"), clamp("e").alias("e")).where("s < e")


def coverage_runs(aln: DataFrame, header: DataFrame, param: ScanParam | None = None, bin_size: int = BIN, by: Sequence[str] = (), groups: DataFrame | None = None) -> DataFrame:
    """Maximal runs of equal depth from 0 to every contig's end, zero depth included. Regions do not apply. With `by`, for each of
    groups, which are those of aln if not given."""
    if by and groups is None:
        groups = aln.select(*by).distinct()
    return runs_of(cigar_blocks(aln, header, param, by), header, bin_size, by, groups)


def runs_of(covered: DataFrame, header: DataFrame, bin_size: int = BIN, by: Sequence[str] = (), groups: DataFrame | None = None) -> DataFrame:
    keys = [*by, "ref_id"]
    step = lambda at, d: F.struct(F.col(at).alias("at"), F.lit(d).cast("long").alias("d"))
    events = covered.select(*keys, F.explode(F.array(step("s", 1), step("e", -1))).alias("x")).select(*keys, "x.at", "x.d")
    starts = each_contig(header, groups).where("seqlength > 0").select(*keys, F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("d"))
    net = events.unionByName(starts).withColumn("bin", F.floor(F.col("at") / bin_size)).groupBy(*keys, "bin", "at").agg(F.sum("d").alias("d")).where("d <> 0 or at = 0")
    within = Window.partitionBy(*keys, "bin").orderBy("at")
    over = Window.partitionBy(*keys).orderBy("bin")
    bins = net.groupBy(*keys, "bin").agg(F.sum("d").alias("total"), F.min("at").alias("first"))
    bins = bins.select(*keys, "bin", (F.sum("total").over(over) - F.col("total")).alias("before"), F.lead("first").over(over).alias("next"))
    local = net.select(*keys, "bin", "at", F.sum("d").over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("v"), F.lead("at").over(within).alias("to"))
    runs = local.join(bins, [*keys, "bin"]).join(header.select("ref_id", "seqname", F.col("seqlength").cast("long").alias("len")), "ref_id")
    end = F.least(F.coalesce("to", "next", "len"), F.col("len"))
    return runs.where("at < len").select(*by, "ref_id", "seqname", F.col("at").alias("start"), end.alias("end"), (F.col("v") + F.col("before")).alias("value"))


def bedgraph(runs: DataFrame) -> DataFrame:
    return runs.where("value > 0")


def auc(runs: DataFrame) -> DataFrame:
    return runs.agg(F.coalesce(F.sum(F.col("value") * (F.col("end") - F.col("start"))), F.lit(0)).cast("long").alias("auc"))


def summary(runs: DataFrame) -> DataFrame:
    """n_bases, min, max, sum, sumsq over the covered bases."""
    n, v = F.col("end") - F.col("start"), F.col("value")
    return bedgraph(runs).agg(F.sum(n).cast("long").alias("n_bases"), F.min(v).cast("long").alias("min_value"), F.max(v).cast("long").alias("max_value"), F.sum(v * n).cast("long").alias("sum_value"), F.sum(v * v * n).cast("long").alias("sumsq_value"))


def _binned(runs: DataFrame, width) -> DataFrame:
    """Covered runs cut at multiples of width (a column or a number): ref_id, zoom_bin, len, value."""
    size = F.lit(width).cast("long") if isinstance(width, int) else width
    cut = bedgraph(runs).withColumn("__w", size)
    cut = cut.withColumn("zoom_bin", F.explode(F.sequence(F.floor(F.col("start") / F.col("__w")), F.floor((F.col("end") - 1) / F.col("__w")))))
    n = F.least("end", (F.col("zoom_bin") + 1) * F.col("__w")) - F.greatest("start", F.col("zoom_bin") * F.col("__w"))
    return cut.withColumn("len", n)


def zoom_widths(runs: DataFrame, header: DataFrame, levels: int = 10) -> list[int]:
    """Zoom levels: 16 times the mean run width, 10 at least and the longest contig at most; then fourfold while shorter than that."""
    mean = bedgraph(runs).agg(F.avg(F.col("end") - F.col("start"))).first()[0]
    longest = header.agg(F.max("seqlength")).first()[0]
    out: list[int] = []
    if mean is None or not longest:
        return out
    width = min(max(10, 16 * int(mean)), int(longest))
    while len(out) < levels and width <= longest:
        out.append(width)
        width *= 4
    return out


TOTALS = {"n_bases": F.sum, "min_value": F.min, "max_value": F.max, "sum_value": F.sum, "sumsq_value": F.sum}


def zoom_summary(runs: DataFrame, width: int) -> DataFrame:
    """ref_id, zoom_bin, n_bases, min, max, sum, sumsq of the covered bases of each bin."""
    v, n = F.col("value"), F.col("len")
    parts = {"n_bases": n, "min_value": v, "max_value": v, "sum_value": v * n, "sumsq_value": v * v * n}
    return _binned(runs, width).groupBy("ref_id", "zoom_bin").agg(*[total(parts[c]).cast("long").alias(c) for c, total in TOTALS.items()])


def coarser(zoom: DataFrame, times: int) -> DataFrame:
    """The zoom_summary of bins that are `times` as wide, from that of the finer bins."""
    return zoom.groupBy("ref_id", F.floor(F.col("zoom_bin") / times).alias("zoom_bin")).agg(*[total(c).cast("long").alias(c) for c, total in TOTALS.items()])


def _statistics(stat: str, width):
    """A statistic of covered bases from nb, s, q, lowest, highest."""
    return {
        "mean": F.col("s") / F.col("nb"),
        "std": F.when(F.col("nb") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / F.col("nb")) / F.greatest(F.col("nb") - 1, F.lit(1.0))))),
        "max": F.col("highest"), "min": F.col("lowest"), "cov": F.col("nb") / width, "sum": F.col("s"),
    }[stat]


def _edges(header: DataFrame, n_bins: int) -> DataFrame:
    edges = header.where("seqlength > 0").select("ref_id", "seqname", F.col("seqlength").cast("long").alias("len"), F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    return edges.select("ref_id", "seqname", "bin", F.floor(F.col("len") * F.col("bin") / n_bins).alias("lo"), F.floor(F.col("len") * (F.col("bin") + 1) / n_bins).alias("hi"))


def _collected(near: DataFrame, n) -> DataFrame:
    """nb, s, q, lowest, highest of each bin; n: how much of a row's stretch lies in the bin."""
    near = near.withColumn("n", n.cast("double")).where("n > 0")
    return near.groupBy("ref_id", "bin").agg(F.sum("n").alias("nb"), F.sum(F.col("v") * F.col("n")).alias("s"), F.sum(F.col("v") * F.col("v") * F.col("n")).alias("q"), F.min("v").alias("lowest"), F.max("v").alias("highest"))


def _into_bins(rows: DataFrame, header: DataFrame, n_bins: int) -> DataFrame:
    """rows(ref_id, start, end) once for each bin that they may touch, with its lo and hi."""
    near = rows.join(header.select("ref_id", F.col("seqlength").cast("long").alias("len")), "ref_id")
    at = lambda c: F.floor(c * n_bins / F.col("len")).cast("int")
    near = near.withColumn("bin", F.explode(F.sequence(at(F.col("start")), F.least(at(F.col("end") - 1) + 1, F.lit(n_bins - 1)))))
    return near.withColumns({"lo": F.floor(F.col("len") * F.col("bin") / n_bins), "hi": F.floor(F.col("len") * (F.col("bin") + 1) / n_bins)})


def bin_stats(runs: DataFrame, header: DataFrame, n_bins: int, stat: str) -> DataFrame:
    """seqname, bin, value: mean, std (n - 1), max, min, cov (covered share) or sum of the covered bases of each of n_bins
    bins of a contig, whose edges are floor(length * i / n_bins). Without a covered base the value is NaN."""
    near = _into_bins(bedgraph(runs).select("ref_id", "start", "end", F.col("value").cast("double").alias("v")), header, n_bins)
    got = _collected(near, F.least("end", "hi") - F.greatest("start", "lo"))
    value = _statistics(stat, (F.col("hi") - F.col("lo")).cast("double"))
    return _edges(header, n_bins).join(got, ["ref_id", "bin"], "left").select("seqname", "bin", F.coalesce(value, F.lit(float("nan"))).alias("value"))


def zoom_bin_stats(zoom: DataFrame, width: int, header: DataFrame, n_bins: int, stat: str) -> DataFrame:
    """bin_stats, approximately, from a zoom_summary of bins of `width`, which should be at most half as wide as the bins asked for:
    a zoom bin that lies across an edge gives each side its share."""
    rows = zoom.withColumns({"start": F.col("zoom_bin") * width, "end": (F.col("zoom_bin") + 1) * width})
    near = _into_bins(rows, header.where("seqlength > 0"), n_bins)
    end = F.least("end", "len")
    share = (F.least(end, F.col("hi")) - F.greatest("start", "lo")) / (end - F.col("start"))
    near = near.withColumn("share", share).where("share > 0")
    total = lambda c: F.sum(F.col(c) * F.col("share"))
    got = near.groupBy("ref_id", "bin").agg(total("n_bases").alias("nb"), total("sum_value").alias("s"), total("sumsq_value").alias("q"), F.min("min_value").cast("double").alias("lowest"), F.max("max_value").cast("double").alias("highest"))
    value = _statistics(stat, (F.col("hi") - F.col("lo")).cast("double"))
    return _edges(header, n_bins).join(got, ["ref_id", "bin"], "left").select("seqname", "bin", F.coalesce(value, F.lit(float("nan"))).alias("value"))


def base_values(runs: DataFrame, queries: DataFrame, fill: bool = False) -> DataFrame:
    """query, pos, value of every covered base of queries (query, ref_id, qs, qe); with fill also of the others, as NaN."""
    from readloom.operators.regions import overlap_query

    hit = overlap_query(bedgraph(runs), queries).where("least(end, qe) > greatest(start, qs)")
    got = hit.select("query", F.explode(F.sequence(F.greatest("start", "qs"), F.least("end", "qe") - 1)).alias("pos"), F.col("value").cast("double").alias("value"))
    if not fill:
        return got
    every = queries.where("qe > qs").select("query", F.explode(F.sequence("qs", F.col("qe") - 1)).alias("pos"))
    return every.join(got, ["query", "pos"], "left").fillna(float("nan"), ["value"]).select("query", "pos", F.coalesce("value", F.lit(float("nan"))).alias("value"))
