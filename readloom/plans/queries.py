"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions import cigar as cigars
from readloom.functions.decode import decode_qual, decode_seq, decode_seqqual
from readloom.functions.intervals import overlap_length as shared_bases
from readloom.functions.params import ScanParam, is_unmapped
from readloom.operators import aggregate, compare, coverage, pairs, project, regions, runs
from readloom.plans import views
from readloom.plans.views import WITH

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SPEC = {"isSecondaryAlignment": False, "isUnmappedQuery": False, "isNotPassingQualityControls": False, "isMinusStrand": True, "isPaired": None}
REGIONS = [("NATION_18", 900, 1400, "late"), ("NATION_18", 1000, 1200, "inner"), ("NATION_6", 0, 300, None), ("NATION_7", 700, 600, None), ("NATION_6", 200, 500, "next"), ("NOWHERE", 1, 100, None), ("NATION_18", 5000, 6000, "none")]
SPANS = [(0, 3, 100, 400), (1, 18, 0, 60), (2, 18, 1900, 4000), (3, 24, 500, 500)]
N_BINS = 10


def query(sql: str | None = None):
    """Registers a function (alignments, header) -> DataFrame under its name, with its SQL after the views."""
    def add(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(views.alignments(spark, sf_dir), views.header(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = WITH + sql
        return f

    return add


LOST = "(ref_id < 0 OR (flag & 4) <> 0)"
_region_rows = ", ".join(f"({i}, '{n}', {max(1, s)}, {max(1, s, e)}, '{label or f'{n}:{s}-{e}'}')" for i, (n, s, e, label) in enumerate(REGIONS))
REGION_SQL = f", reg AS (SELECT v.*, hdr.ref_id AS rid FROM (VALUES {_region_rows}) AS v(ord, name, s, e, label) LEFT JOIN hdr ON hdr.seqname = v.name), hit AS (SELECT aln.*, (SELECT min_by(label, ord) FROM reg WHERE rid = aln.ref_id AND aln.pos BETWEEN s AND e) AS which_label FROM aln WHERE NOT {LOST})"
BLOCKS = """, rel(cg, rs, re) AS (VALUES ('50M', 0, 50), ('20M500N30M', 0, 20), ('20M500N30M', 520, 550), ('10S40M', 0, 40), ('25M2I23M', 0, 25), ('25M2I23M', 25, 48),
  ('25M3D25M', 0, 25), ('25M3D25M', 25, 28), ('25M3D25M', 28, 53), ('5H30=2X18=', 0, 30), ('5H30=2X18=', 30, 32), ('5H30=2X18=', 32, 50), ('40M10P10M', 0, 40), ('40M10P10M', 40, 50)),
blk AS (SELECT a.ref_id, least(a.pos - 1 + rs, seqlength) AS s, least(a.pos - 1 + re, seqlength) AS e FROM aln a JOIN rel ON cg = cigar JOIN hdr h ON h.ref_id = a.ref_id WHERE (flag & 4) = 0)"""
RUNS = BLOCKS + """, ev AS (SELECT ref_id, s AS px, 1 AS d FROM blk WHERE s < e UNION ALL SELECT ref_id, e, -1 FROM blk WHERE s < e UNION ALL SELECT ref_id, 0, 0 FROM hdr),
net AS (SELECT ref_id, px, sum(d) AS d FROM ev GROUP BY ref_id, px HAVING sum(d) <> 0 OR px = 0),
run AS (SELECT net.ref_id, seqname, px AS s, coalesce(lead(px) OVER w, seqlength) AS e, sum(d) OVER w AS v, seqlength FROM net JOIN hdr ON hdr.ref_id = net.ref_id WINDOW w AS (PARTITION BY net.ref_id ORDER BY px)),
runs AS (SELECT ref_id, seqname, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, CAST(v AS BIGINT) AS v FROM run WHERE s < seqlength)"""
SPAN_SQL = f", span(q, rid, qs, qe) AS (VALUES {', '.join(map(str, SPANS))})"


def _runs(aln: DataFrame, header: DataFrame) -> DataFrame:
    return coverage.coverage_runs(aln, header)


def _spans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPANS, "query int, ref_id int, qs long, qe long")


@query(" SELECT CAST(ref_id AS INTEGER) AS ref_id, seqname, CAST(seqlength AS INTEGER) AS seqlength FROM hdr")
def header_contigs(aln, header):
    return header.select(F.col("ref_id").cast("int"), "seqname", F.col("seqlength").cast("int"))


@query(f" SELECT qname, CAST(flag AS INTEGER) AS flag, CASE WHEN NOT {LOST} THEN seqname END AS rname, CASE WHEN NOT {LOST} THEN pos END AS pos, mapq, cigar FROM aln LEFT JOIN hdr USING (ref_id)")
def project_core_fields(aln, header):
    return project.scan(aln, header).withColumn("flag", F.col("flag").cast("int"))


@query(f" SELECT qname, CAST(flag AS INTEGER) AS flag, CASE WHEN {LOST} THEN '*' WHEN (flag & 16) <> 0 THEN '-' ELSE '+' END AS strand FROM aln")
def strand_projection(aln, header):
    return aln.select("qname", F.col("flag").cast("int").alias("flag"), project.strand().alias("strand"))


@query(" SELECT qname, h.seqname AS mrnm, CASE WHEN mpos >= 1 THEN mpos END AS mpos, isize FROM aln LEFT JOIN hdr h ON h.ref_id = aln.mate_ref_id")
def mate_fields(aln, header):
    return project.scan(aln, header, ScanParam(what=("qname", "mrnm", "mpos", "isize")))


@query(" SELECT aln.ref_id, seqname AS rname, CAST(count(*) AS BIGINT) AS n FROM aln LEFT JOIN hdr ON hdr.ref_id = aln.ref_id GROUP BY 1, 2")
def rname_lookup(aln, header):
    return project.with_names(aln, header).groupBy("ref_id", "rname").agg(F.count("*").alias("n"))


@query(" SELECT cigar, cigar AS again, CAST(len(regexp_extract_all(cigar, '[MIDNSHPX=]')) AS INTEGER) AS n_ops, CAST(count(*) AS BIGINT) AS n FROM aln GROUP BY cigar")
def cigar_roundtrip(aln, header):
    ops = cigars.parse(F.col("cigar"))
    return aln.groupBy("cigar").agg(F.count("*").alias("n")).select("cigar", cigars.to_text(ops).alias("again"), F.size(ops).alias("n_ops"), "n")


@query(BLOCKS + " SELECT ref_id, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, CAST(count(*) AS BIGINT) AS n FROM blk WHERE s < e GROUP BY 1, 2, 3")
def cigar_blocks(aln, header):
    return coverage.cigar_blocks(aln, header).groupBy("ref_id", "s", "e").agg(F.count("*").alias("n"))


@query(" SELECT qname, CAST(flag AS INTEGER) AS flag, mapq FROM aln WHERE (flag & 65) = 65 AND (flag & 1540) = 0")
def flag_filter(aln, header):
    return aln.where(ScanParam(flag_set=65, flag_unset=1540).flag_predicate()).select("qname", F.col("flag").cast("int").alias("flag"), "mapq")


@query(" SELECT qname, CAST(flag AS INTEGER) AS flag, mapq FROM aln WHERE (flag & 16) = 16 AND (flag & (256 + 4 + 512)) = 0")
def flag_spec_filter(aln, header):
    return aln.where(ScanParam(flag=SPEC).flag_predicate()).select("qname", F.col("flag").cast("int").alias("flag"), "mapq")


@query(" SELECT qname, mapq FROM aln WHERE mapq >= 30")
def mapq_filter(aln, header):
    return aln.where(ScanParam(min_mapq=30, mapq_filter=10).flag_predicate()).select("qname", "mapq")


@query(f" SELECT CASE WHEN {LOST} THEN 'unmapped' ELSE 'mapped' END AS kind, CAST(count(*) AS BIGINT) AS n FROM aln GROUP BY 1 UNION ALL SELECT 'kept', CAST(count(*) AS BIGINT) FROM aln WHERE NOT {LOST}")
def include_unmapped(aln, header):
    kinds = aln.groupBy(F.when(is_unmapped(), "unmapped").otherwise("mapped").alias("kind")).agg(F.count("*").alias("n"))
    kept = project.scan(aln, header, ScanParam(what=("qname",), include_unmapped=False)).agg(F.count("*").alias("n"))
    return kinds.unionByName(kept.withColumn("kind", F.lit("kept")))


@query(f" SELECT seqname AS rname, pos, cigar, CASE WHEN (flag & 16) <> 0 THEN '-' ELSE '+' END AS strand, qname, mapq FROM aln JOIN hdr USING (ref_id) WHERE NOT {LOST} AND mapq >= 10")
def mapped_alignments(aln, header):
    return project.mapped_alignments(aln, header, ScanParam(min_mapq=10), ("qname", "mapq"))


@query(REGION_SQL + " SELECT qname, pos, seqname AS rname FROM hit JOIN hdr USING (ref_id) WHERE which_label IS NOT NULL")
def region_filter(aln, header):
    return project.scan(aln, header, ScanParam(what=("qname", "pos", "rname"), which=tuple(REGIONS))).drop("which_label")


@query(REGION_SQL + " SELECT which_label, ref_id, pos, CAST(count(*) AS BIGINT) AS n FROM hit WHERE which_label IS NOT NULL GROUP BY 1, 2, 3")
def region_first_match(aln, header):
    return regions.label_regions(aln, header, REGIONS, chain=3).groupBy("which_label", "ref_id", "pos").agg(F.count("*").alias("n"))


@query(REGION_SQL + " SELECT ord AS batch, label AS which_label, qname, pos FROM (SELECT ord, label FROM reg) LEFT JOIN hit ON which_label = label")
def region_batches(aln, header):
    return regions.region_batches(aln, header, REGIONS).select("batch", "which_label", "qname", "pos")


@query(f" SELECT seqname, CAST(seqlength AS BIGINT) AS seqlength, CAST(coalesce(c, 0) AS BIGINT) AS count FROM hdr LEFT JOIN (SELECT ref_id, count(*) AS c FROM aln WHERE NOT {LOST} AND mapq >= 5 GROUP BY 1) USING (ref_id) UNION ALL SELECT '*', NULL, CAST(count(*) AS BIGINT) FROM aln WHERE {LOST} AND mapq >= 5")
def bam_count(aln, header):
    return aggregate.count_by_contig(aln, header, ScanParam(min_mapq=5))


_FRAGMENTS = " SELECT abs(CAST(isize AS BIGINT)) AS fragment_size, CAST(count(*) AS BIGINT) AS count FROM aln"


@query(_FRAGMENTS + " WHERE (flag & 8) = 0 GROUP BY 1")
def fragment_sizes(aln, header):
    return aggregate.fragment_sizes(aln)


@query(_FRAGMENTS + " WHERE (flag & 1024) = 0 GROUP BY 1")
def fragment_sizes_keep_mate_unmapped(aln, header):
    return aggregate.fragment_sizes(aln, ScanParam(flag={"isDuplicate": False}), drop_mate_unmapped=False)


@query(" SELECT mapq, CAST(count(*) AS BIGINT) AS count FROM aln GROUP BY 1")
def mapq_dist(aln, header):
    return aggregate.mapq_dist(aln)


@query(RUNS + ' SELECT seqname, s AS start, e AS "end", e - s AS run_length, v AS value FROM runs')
def coverage_runs(aln, header):
    return _runs(aln, header).select("seqname", "start", "end", (F.col("end") - F.col("start")).alias("run_length"), "value")


@query(RUNS + ' SELECT seqname, s AS start, e AS "end", v AS value FROM runs WHERE v > 0')
def coverage_bedgraph(aln, header):
    return coverage.bedgraph(coverage.coverage_runs(aln, header, bin_size=97)).select("seqname", "start", "end", "value")


@query(RUNS + " SELECT CAST(sum(v * (e - s)) AS BIGINT) AS auc FROM runs")
def coverage_auc(aln, header):
    return coverage.auc(_runs(aln, header))


@query(RUNS + " SELECT CAST(sum(e - s) AS BIGINT) AS n_bases, min(v) AS min_value, max(v) AS max_value, CAST(sum(v * (e - s)) AS BIGINT) AS sum_value, CAST(sum(v * v * (e - s)) AS BIGINT) AS sumsq_value FROM runs WHERE v > 0")
def coverage_summary(aln, header):
    return coverage.summary(_runs(aln, header))


@query(RUNS + """, p AS (SELECT ref_id, v, unnest(range(s, e)) AS px FROM runs WHERE v > 0)
SELECT ref_id, CAST(px // 100 AS BIGINT) AS zoom_bin, CAST(count(*) AS BIGINT) AS n_bases, min(v) AS min_value, max(v) AS max_value, CAST(sum(v) AS BIGINT) AS sum_value, CAST(sum(v * v) AS BIGINT) AS sumsq_value FROM p GROUP BY 1, 2""")
def coverage_zoom_summary(aln, header):
    return coverage.zoom_summary(_runs(aln, header), 100)


_BINNED = RUNS + f""", bins AS (SELECT ref_id, seqname, i AS bin, CAST(floor(seqlength * i / {N_BINS}.0) AS BIGINT) AS lo, CAST(floor(seqlength * (i + 1) / {N_BINS}.0) AS BIGINT) AS hi FROM hdr, range({N_BINS}) AS r(i)),
p AS (SELECT ref_id, CAST(v AS DOUBLE) AS v, unnest(range(s, e)) AS px FROM runs WHERE v > 0),
st AS (SELECT b.seqname, b.bin, b.hi - b.lo AS width, count(p.px) AS nb, sum(v) AS s, sum(v * v) AS q, min(v) AS lowest, max(v) AS highest FROM bins b LEFT JOIN p ON p.ref_id = b.ref_id AND p.px >= b.lo AND p.px < b.hi GROUP BY ALL)
SELECT seqname, CAST(bin AS INTEGER) AS bin, coalesce({{0}}, CAST('NaN' AS DOUBLE)) AS value FROM st"""
_STATS = {
    "mean": "s / nullif(nb, 0)", "max": "highest", "min": "lowest", "cov": "CASE WHEN nb > 0 THEN CAST(nb AS DOUBLE) / width END", "sum": "s",
    "std": "CASE WHEN nb > 1 THEN sqrt(greatest(0.0, (q - s * s / nb) / (nb - 1))) END",
}
for _stat, _expr in _STATS.items():
    QUERIES[f"coverage_bins_{_stat}"] = lambda spark, sf_dir, stat=_stat: coverage.bin_stats(_runs(views.alignments(spark, sf_dir), views.header(spark, sf_dir)), views.header(spark, sf_dir), N_BINS, stat)
    ORACLES[f"coverage_bins_{_stat}"] = WITH + _BINNED.format(_expr)


@query(RUNS + SPAN_SQL + ' SELECT q AS query, seqname, s AS start, e AS "end", v AS value FROM runs JOIN span ON rid = ref_id AND e > qs AND s < qe WHERE v > 0')
def bigwig_interval_query(aln, header):
    return regions.overlap_query(coverage.bedgraph(_runs(aln, header)), _spans(aln.sparkSession)).select("query", "seqname", "start", "end", "value")


@query(RUNS + SPAN_SQL + """, want AS (SELECT q, rid, unnest(range(qs, qe)) AS pos FROM span)
SELECT q AS query, pos, coalesce(CAST(max(v) AS DOUBLE), CAST('NaN' AS DOUBLE)) AS value FROM want LEFT JOIN runs ON rid = ref_id AND pos >= s AND pos < e AND v > 0 GROUP BY 1, 2""")
def bigwig_values(aln, header):
    return coverage.base_values(_runs(aln, header), _spans(aln.sparkSession), fill=True)


@query(" SELECT pos, mpos, CAST(greatest(0, least(pos + 50, mpos + 50) - greatest(pos, mpos)) AS INTEGER) AS bases, CAST(count(*) AS BIGINT) AS n FROM aln GROUP BY 1, 2, 3")
def overlap_length(aln, header):
    p, m = F.col("pos"), F.col("mpos")
    return aln.select("pos", "mpos", shared_bases(p, p + 50, m, m + 50).cast("int").alias("bases")).groupBy("pos", "mpos", "bases").agg(F.count("*").alias("n"))


_FILE_ORDER = ", ".join(views.ORDER)


@query(f""", st AS (SELECT *, CASE WHEN {LOST} THEN '*' WHEN (flag & 16) <> 0 THEN '-' ELSE '+' END AS strand FROM aln),
ch AS (SELECT strand, row_number() OVER (ORDER BY {_FILE_ORDER}) AS n, strand IS DISTINCT FROM lag(strand) OVER (ORDER BY {_FILE_ORDER}) AS new FROM st),
id AS (SELECT strand, sum(CASE WHEN new AND n > 1 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS run FROM ch)
SELECT CAST(run AS BIGINT) AS run, strand AS value, CAST(count(*) AS BIGINT) AS run_length FROM id GROUP BY 1, 2""")
def strand_runs(aln, header):
    return runs.run_lengths(aln.withColumn("strand", project.strand()), "strand", views.ORDER, F.floor(F.col("l_orderkey") / 1000))


_SIDE = f"SELECT qname, pos, ref_id, row_number() OVER (PARTITION BY qname ORDER BY {_FILE_ORDER}) AS k FROM aln WHERE NOT {LOST} AND (flag & 1) <> 0 AND (flag & {{}}) <> 0"


@query(f", a AS ({_SIDE.format(64)}), b AS ({_SIDE.format(128)}) SELECT a.qname, CAST(a.k AS INTEGER) AS pair_idx, a.ref_id AS first_ref_id, a.pos AS first_pos, b.ref_id AS last_ref_id, b.pos AS last_pos FROM a JOIN b ON a.qname = b.qname AND a.k = b.k")
def mate_pairs(aln, header):
    return pairs.mate_pairs(aln, views.ORDER, ["ref_id", "pos"])


@query(f", a AS ({_SIDE.format(64)}), b AS ({_SIDE.format(128)}) SELECT CAST(sum(abs(x.n - y.n)) AS BIGINT) AS dropped FROM (SELECT qname, count(*) AS n FROM a GROUP BY 1) x JOIN (SELECT qname, count(*) AS n FROM b GROUP BY 1) y USING (qname)")
def mate_pairs_dropped(aln, header):
    return pairs.dropped_mates(aln)


@query(", a AS (SELECT mapq, count(*) AS n FROM aln GROUP BY 1), b AS (SELECT mapq, count(*) AS n FROM aln WHERE (flag & 16) = 0 AND mapq < 40 GROUP BY 1) SELECT mapq, CAST(coalesce(a.n, 0) AS BIGINT) AS count_a, CAST(coalesce(b.n, 0) AS BIGINT) AS count_b, CAST(coalesce(a.n, 0) - coalesce(b.n, 0) AS BIGINT) AS diff FROM a FULL JOIN b USING (mapq)")
def histogram_diff(aln, header):
    forward = aggregate.mapq_dist(aln.where("mapq < 40"), ScanParam(flag={"isMinusStrand": False}))
    return aggregate.histogram_diff(aggregate.mapq_dist(aln), forward, "mapq")


@query(f" SELECT file, seqname, CAST(count(a.ref_id) AS BIGINT) AS count FROM (SELECT DISTINCT file FROM aln) CROSS JOIN hdr LEFT JOIN (SELECT file, ref_id FROM aln WHERE NOT {LOST}) a USING (file, ref_id) GROUP BY 1, 2")
def multi_file_count(aln, header):
    """Every contig of the header for each file."""
    return aggregate.count_by_contig(aln, header, ScanParam(include_unmapped=False), by=["file"]).drop("seqlength")


@query(" SELECT file, abs(CAST(isize AS BIGINT)) AS fragment_size, CAST(count(*) AS BIGINT) AS count FROM aln WHERE (flag & 8) = 0 GROUP BY 1, 2")
def multi_file_fragment_sizes(aln, header):
    return aggregate.fragment_sizes(aln, by=["file"])


@query(" SELECT file, mapq, CAST(count(*) AS BIGINT) AS count FROM aln GROUP BY 1, 2")
def multi_file_mapq(aln, header):
    return aggregate.mapq_dist(aln, by=["file"])


_FILE_RUNS = BLOCKS.replace("SELECT a.ref_id,", "SELECT a.file, a.ref_id,") + """, ev AS (SELECT file, ref_id, s AS px, 1 AS d FROM blk WHERE s < e UNION ALL SELECT file, ref_id, e, -1 FROM blk WHERE s < e UNION ALL SELECT file, ref_id, 0, 0 FROM (SELECT DISTINCT file FROM aln) CROSS JOIN hdr),
net AS (SELECT file, ref_id, px, sum(d) AS d FROM ev GROUP BY file, ref_id, px HAVING sum(d) <> 0 OR px = 0),
run AS (SELECT file, seqname, px AS s, coalesce(lead(px) OVER w, seqlength) AS e, sum(d) OVER w AS v, seqlength FROM net JOIN hdr ON hdr.ref_id = net.ref_id WINDOW w AS (PARTITION BY file, net.ref_id ORDER BY px))"""


@query(_FILE_RUNS + ' SELECT file, seqname, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", CAST(v AS BIGINT) AS value FROM run WHERE s < seqlength')
def multi_file_coverage(aln, header):
    return coverage.coverage_runs(aln, header, by=["file"]).select("file", "seqname", "start", "end", "value")


_ZOOMED = RUNS + """, p AS (SELECT ref_id, v, unnest(range(s, e)) AS px FROM runs WHERE v > 0)
SELECT ref_id, CAST(px // 400 AS BIGINT) AS zoom_bin, CAST(count(*) AS BIGINT) AS n_bases, min(v) AS min_value, max(v) AS max_value, CAST(sum(v) AS BIGINT) AS sum_value, CAST(sum(v * v) AS BIGINT) AS sumsq_value FROM p GROUP BY 1, 2"""


@query(_ZOOMED)
def coverage_zoom_coarser(aln, header):
    """A zoom level from the next finer one."""
    return coverage.coarser(coverage.zoom_summary(_runs(aln, header), 100), 4)


@query(f""", z AS (SELECT ref_id, zb, least((zb + 1) * 20, seqlength) AS ze, n, lowest, highest, s FROM (
  SELECT ref_id, px // 20 AS zb, count(*) AS n, min(v) AS lowest, max(v) AS highest, sum(v) AS s FROM (SELECT ref_id, v, unnest(range(s, e)) AS px FROM runs WHERE v > 0) GROUP BY 1, 2) JOIN hdr USING (ref_id)),
bins AS (SELECT ref_id, seqname, i AS bin, CAST(floor(seqlength * i / {N_BINS}.0) AS BIGINT) AS lo, CAST(floor(seqlength * (i + 1) / {N_BINS}.0) AS BIGINT) AS hi FROM hdr, range({N_BINS}) AS r(i))
SELECT b.seqname, CAST(b.bin AS INTEGER) AS bin, coalesce(CAST(max(highest) AS DOUBLE), CAST('NaN' AS DOUBLE)) AS value
FROM bins b LEFT JOIN z ON z.ref_id = b.ref_id AND z.zb * 20 < b.hi AND z.ze > b.lo GROUP BY ALL""".replace(", z AS", RUNS + ", z AS", 1))
def zoom_bins_max(aln, header):
    """Bin maxima from a zoom level, as a viewer asks for them."""
    return coverage.zoom_bin_stats(coverage.zoom_summary(_runs(aln, header), 20), 20, header, N_BINS, "max")


@query(" SELECT CAST(flag AS INTEGER) AS flag, mapq, CAST(n AS BIGINT) AS surplus FROM (SELECT flag, mapq, sum(CASE WHEN (flag & 16) = 0 THEN 1 ELSE -1 END) AS n FROM aln GROUP BY 1, 2) WHERE n <> 0")
def unequal_rows(aln, header):
    """Forward against reverse reads, compared as two results whose order does not matter."""
    side = lambda cond: aln.where(cond).select(F.col("flag").cast("int").alias("flag"), "mapq")
    return compare.unequal_rows(side((F.col("flag").bitwiseAND(16)) == 0), side((F.col("flag").bitwiseAND(16)) != 0))


@query(f", m AS (SELECT qname, mapq, abs(isize) AS size, row_number() OVER (PARTITION BY qname ORDER BY abs(abs(isize) - 500), {_FILE_ORDER}) AS n FROM aln WHERE abs(isize) BETWEEN 100 AND 900) SELECT qname, mapq, size FROM m WHERE n = 1 ORDER BY size DESC, qname LIMIT 24")
def topk_dedup_manifest(aln, header):
    """A size band, one entry of each group, the one closest to a target, and the largest of these."""
    size = F.abs("isize")
    one = Window.partitionBy("qname").orderBy(F.abs(size - 500), *views.ORDER)
    best = aln.where(size.between(100, 900)).withColumn("n", F.row_number().over(one)).where("n = 1")
    return best.select("qname", "mapq", size.alias("size")).orderBy(F.desc("size"), "qname").limit(24)


_HEX = "(SELECT doc_id, upper(md5({})) AS h FROM documents)"
_QUAL = "array_to_string(list_transform(range(1, 17), lambda i: chr(CAST(33 + (16 * (instr('0123456789ABCDEF', substr(h, 2 * i - 1, 1)) - 1) + instr('0123456789ABCDEF', substr(h, 2 * i, 1)) - 1) % 94 AS INTEGER))), '')"
ORACLES["decode_seq"] = f"SELECT doc_id, substr(translate(h, '0123456789ABCDEF', '=ACMGRSVTWYHKDBN'), 1, 31) AS seq FROM {_HEX.format('text')}"
QUERIES["decode_seq"] = lambda spark, sf_dir: views.packed(spark, sf_dir).select("doc_id", decode_seq(F.col("seq"), F.col("qwidth")).alias("seq"))
ORACLES["decode_qual"] = f"SELECT doc_id, {_QUAL} AS qual FROM {_HEX.format('text')}"


def _printable(raw):
    """Bytes of at most 93, so that the text stays printable."""
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.lpad(F.hex(F.conv(F.substring(F.hex(raw), 2 * i - 1, F.lit(2)), 16, 10).cast("int") % 94), 2, "0")), ""))


QUERIES["decode_qual"] = lambda spark, sf_dir: views.packed(spark, sf_dir).select("doc_id", decode_qual(_printable(F.col("seq"))).alias("qual"))
ORACLES["decode_seqqual"] = f"SELECT doc_id, 31 AS qwidth, s.seq, {_QUAL} AS qual FROM {_HEX.format('lang')} JOIN ({ORACLES['decode_seq']}) s USING (doc_id)"
QUERIES["decode_seqqual"] = lambda spark, sf_dir: decode_seqqual(views.packed(spark, sf_dir).withColumn("qual", _printable(F.col("qual"))))
