"""Traps of the alignment semantics on hand-written records, and files written and read back."""

import math
import random
import struct

import pytest

from readloom import api
from readloom.functions import cigar, decode, params
from readloom.functions.params import Interval, ScanParam
from readloom.operators import aggregate, compare, coverage, pairs, project, regions, resources, runs
from readloom.sources import bam, bigwig, files, ingest
from readloom.streaming import ingest as stream

CONTIGS = [("c1", 100), ("c2", 60), ("c0", 0), ("quiet", 10)]
COLS = ["qname", "flag", "ref_id", "pos", "mapq", "cigar", "isize", "mate_ref_id", "mpos", "n"]
ROWS = [
    ("a", 65, 0, 1, 60, "10M", 30, 0, 21, 0), ("a", 129, 0, 21, 60, "5M5N5M", -30, 0, 1, 1), ("a", 65, 0, 95, 10, "10M", 0, 1, 0, 2),
    ("b", 65, 1, 1, 255, "5M2D5M", -2147483648, 9, 5, 3), ("b", 4 | 65, 0, 50, 7, "10M", 5, 0, 50, 4), ("c", 0, 9, 5, 30, "10M", 0, -1, 0, 5),
    ("d", 16, 1, 51, 30, "10M", 0, -1, 0, 6), ("e", 8, 0, 91, 30, "10M", 77, -1, 0, 7), ("f", 65 | 128, 0, 5, 30, "", 1, -1, 0, 8), ("g", 65, 0, 5, 30, "4M", 1, -1, 0, 9),
]


@pytest.fixture(scope="module")
def aln(spark):
    return spark.createDataFrame(ROWS, "qname string, flag int, ref_id int, pos int, mapq int, cigar string, isize int, mate_ref_id int, mpos int, n int")


@pytest.fixture(scope="module")
def header(spark):
    return spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(CONTIGS)], "ref_id int, seqname string, seqlength int")


def test_params():
    assert params.flag_masks({"isPaired": True, "isDuplicate": False, "isUnmappedQuery": None}) == (1, 1024)
    assert params.flag_masks({"isNotPrimaryRead": True, "isSecondaryAlignment": False}) == (256, 256)
    assert ScanParam(min_mapq=-3).mapq == 0 and ScanParam(min_mapq=float("nan")).mapq == 0 and ScanParam(min_mapq=5, mapq_filter=9).mapq == 5
    assert ScanParam(what=("pos", "pos")).fields == ["pos"] and ScanParam(tag=("NM", "", "NM")).tags == ["NM"]
    with pytest.raises(TypeError):
        ScanParam(flag=4)
    with pytest.raises(ValueError):
        ScanParam(what=("nope",))
    with pytest.raises(ValueError):
        params.flag_masks({"nope": True})
    assert params.usable([Interval("c", 0, -5, "x"), Interval("c", None, 4)]) == [Interval("c", 1, 1, "x")]
    assert [r.label for r in params.intervals({"c1": [(0, 5)]})] == ["c1:0-5"]


def test_fields(aln, header):
    got = {r["n"]: r for r in project.with_fields(aln, header).collect()}
    assert (got[4]["rname"], got[4]["pos"], got[4]["strand"]) == (None, None, "*")
    assert (got[5]["rname"], got[5]["pos"], got[5]["strand"]) == (None, 5, "+")
    assert got[6]["strand"] == "-" and got[3]["mrnm"] is None and got[3]["mpos"] == 5 and got[4]["mrnm"] == "c1" and got[2]["mpos"] is None
    assert project.scan(aln, header).columns == list(params.DEFAULT_FIELDS)
    assert project.mapped_alignments(aln, header, extra=("mapq",)).columns == ["rname", "pos", "cigar", "strand", "mapq"]
    assert project.mapped_alignments(aln, header).count() == 8


def test_regions(aln, header):
    first = [("c1", 0, 10, "x"), ("c1", 5, 30, "y"), ("c9", 1, 5, "z")]
    for chain in (200, 0):
        got = {r["n"]: r["which_label"] for r in regions.label_regions(aln, header, first, chain).collect()}
        assert got == {0: "x", 1: "y", 8: "x", 9: "x"}
        got = {r["n"]: r["which_label"] for r in regions.label_regions(aln, header, first[1::-1], chain).collect()}
        assert got == {0: "x", 1: "y", 8: "y", 9: "y"}
    assert {r["which_label"] for r in regions.label_regions(aln, header, [(None, 1, 2)]).collect()} == {"*"}
    assert regions.label_regions(aln, header, [("c9", 1, 2)]).count() == 0
    batches = regions.region_batches(aln, header, [("c1", 21, 21), ("c2", 9, 9, "e"), ("c1", 21, 21)]).collect()
    assert sorted((r["batch"], r["n"]) for r in batches if r["n"] is not None) == [(0, 1), (2, 1)] and any(r["batch"] == 1 and r["n"] is None for r in batches)


def test_first_of(spark, aln, header):
    """Disjoint pieces carry each position's first region, as a walk over all regions in order finds it."""
    rng = random.Random(4)
    for _ in range(200):
        given = [Interval(rng.choice("xy"), s := rng.randint(1, 30), s + rng.randint(0, 20), str(i)) for i in range(rng.randint(0, 8))]
        pieces = regions.first_of(given)
        for name in "xy":
            for at in range(1, 55):
                want = next((r.label for r in given if r.seqname == name and r.start <= at <= r.end), None)
                assert [p[3] for p in pieces if p[0] == name and p[1] <= at <= p[2]] == ([] if want is None else [want])
    rows = [("c1", 1 + 7 * i % 90, 5 + 7 * i % 95, str(i)) for i in range(30)]
    got = [{r["n"]: r["which_label"] for r in regions.label_regions(aln, header, rows, chain, width=8).collect()} for chain in (200, 0)]
    assert got[0] == got[1] and len(got[0]) > 3


def test_overlap_query(spark):
    rng = random.Random(9)
    spans = [(rng.randint(0, 2), s := rng.randint(0, 300), s + rng.randint(1, 90), i) for i in range(60)]
    asked = [(i, rng.randint(0, 3), s := rng.randint(0, 300), s + rng.randint(0, 90)) for i in range(40)]
    left, right = spark.createDataFrame(spans, "ref_id int, start long, end long, value long"), spark.createDataFrame(asked, "query int, ref_id int, qs long, qe long")
    want = sorted((q[0], r[3]) for q in asked for r in spans if q[1] == r[0] and r[2] > q[2] and r[1] < q[3])
    for width in (7, 1 << 14):
        got = regions.overlap_query(left, right, width)
        assert sorted((r["query"], r["value"]) for r in got.collect()) == want and got.columns == ["ref_id", "start", "end", "value", "query", "qs", "qe"]


def test_compare(spark, aln):
    assert compare.same_rows(aln, aln.orderBy("pos")) and not compare.same_rows(aln, aln.unionByName(aln.limit(1)))
    assert [r["surplus"] for r in compare.unequal_rows(aln.unionByName(aln.where("n = 4")), aln).collect()] == [1]
    assert compare.count_records({"a": aln, "b": aln.limit(2)}) == len(ROWS) + 2
    with pytest.raises(ValueError):
        compare.unequal_rows(aln, aln.select("pos"))


def test_counts(aln, header):
    got = {r[0]: (r[1], r[2]) for r in aggregate.count_by_contig(aln, header).collect()}
    assert got == {"c1": (100, 6), "c2": (60, 2), "c0": (0, 0), "quiet": (10, 0), "*": (None, 1)}
    assert {r[0]: r[2] for r in aggregate.count_by_contig(aln, header, ScanParam(which=(Interval("c1", 1, 1),))).collect()}["*"] == 0
    sizes = {r[0]: r[1] for r in aggregate.fragment_sizes(aln).collect()}
    assert sizes[0] == 3 and sizes[2147483648] == 1 and 77 not in sizes
    assert 77 in {r[0] for r in aggregate.fragment_sizes(aln, drop_mate_unmapped=False).collect()}
    assert {r[0]: r[1] for r in aggregate.mapq_dist(aln).collect()}[255] == 1


def depth(rows, contigs, min_mapq=0):
    out = {i: [0] * n for i, (_, n) in enumerate(contigs)}
    for _, flag, ref, pos, mapq, text, *_ in rows:
        if ref not in out or flag & 4 or mapq < min_mapq:
            continue
        at, n = pos - 1, ""
        for ch in text:
            if ch.isdigit():
                n += ch
                continue
            if ch in "M=XD":
                for i in range(max(0, at), min(len(out[ref]), at + int(n))):
                    out[ref][i] += 1
            if ch in "M=XDN":
                at += int(n)
            n = ""
    return out


@pytest.mark.parametrize("bin_size", [7, 1 << 18])
def test_coverage(spark, aln, header, bin_size):
    rng = random.Random(bin_size)
    ops = ["10M", "3M4N3M", "2S5M1I4M", "4M2D4M", "1H6=2X3S", "3M2P3M", ""]
    rows = ROWS + [("x", rng.choice([0, 4, 16, 1024]), rng.choice([-1, 0, 1, 2, 4]), rng.randint(1, 110), rng.randint(0, 60), rng.choice(ops), 0, -1, 0, 0) for _ in range(300)]
    df = spark.createDataFrame(rows, aln.schema).repartition(5)
    got = coverage.coverage_runs(df, header, ScanParam(min_mapq=20), bin_size).collect()
    want = depth(rows, CONTIGS, 20)
    for i, (_, n) in enumerate(CONTIGS):
        mine = sorted((r["start"], r["end"], r["value"]) for r in got if r["ref_id"] == i)
        flat = [v for s, e, v in mine for _ in range(e - s)]
        assert flat == want[i] and all(a[1] == b[0] and a[2] != b[2] for a, b in zip(mine, mine[1:]))
    quiet = [r for r in got if r["seqname"] == "quiet"]
    assert [(r["start"], r["end"], r["value"]) for r in quiet] == [(0, 10, 0)]


def test_by_file(spark, aln, header):
    """Each file's counts, histograms and coverage are those of the file alone, and a named file without records counts too."""
    both = aln.withColumn("file", params.F.when(aln.n % 2 == 0, "even").otherwise("odd"))
    names = spark.createDataFrame([("even",), ("odd",), ("none",)], "file string")
    for name in ("even", "odd"):
        own = both.where(both.file == name)
        mine = lambda df: df.where(df.file == name).drop("file")  # noqa: E731,B023
        assert compare.same_rows(mine(aggregate.count_by_contig(both, header, by=["file"])), aggregate.count_by_contig(own, header))
        assert compare.same_rows(mine(aggregate.fragment_sizes(both, by=["file"])), aggregate.fragment_sizes(own))
        assert compare.same_rows(mine(aggregate.mapq_dist(both, by=["file"])), aggregate.mapq_dist(own))
        assert compare.same_rows(mine(coverage.coverage_runs(both, header, by=["file"])), coverage.coverage_runs(own, header))
    counts = aggregate.count_by_contig(both, header, by=["file"], groups=names).where("file = 'none'").collect()
    assert len(counts) == len(CONTIGS) + 1 and {r["count"] for r in counts} == {0}
    assert [r["mapq"] for r in aggregate.mapq_dist(aln).collect()] == sorted({r[4] for r in ROWS})


def test_zoom(spark, aln, header):
    cov = coverage.coverage_runs(aln, header)
    assert compare.same_rows(coverage.coarser(coverage.zoom_summary(cov, 3), 4), coverage.zoom_summary(cov, 12))
    exact, near = ({(r["seqname"], r["bin"]): r["value"] for r in f} for f in (coverage.bin_stats(cov, header, 5, "mean").collect(), coverage.zoom_bin_stats(coverage.zoom_summary(cov, 4), 4, header, 5, "mean").collect()))
    assert exact.keys() == near.keys() and all(math.isnan(near[k]) if math.isnan(v) else abs(near[k] - v) < 1 for k, v in exact.items())


def test_bin_stats_without_data(aln, header):
    got = coverage.bin_stats(coverage.coverage_runs(aln, header), header, 3, "mean").collect()
    assert len(got) == 9 and all(math.isnan(r["value"]) for r in got if r["seqname"] == "quiet")


def test_pairs(aln):
    got = pairs.mate_pairs(aln, ["n"], ["n"]).collect()
    assert sorted((r["qname"], r["pair_idx"], r["first_n"], r["last_n"]) for r in got) == [("a", 1, 0, 1), ("f", 1, 8, 8)]
    assert pairs.dropped_mates(aln).first()[0] == 1
    seen = pairs.Observation()
    got = pairs.mate_pairs(aln, ["n"], ["n", "pos"], ordered=True, seen=seen).collect()
    assert [r["qname"] for r in got] == ["a", "f"] and seen.get == {"reads": len(ROWS), "dropped": 4}


def test_runs(spark):
    values = list("aabbbabba") + [None, None, "a"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string").repartition(4)
    for width, fanout in ((1, 2), (1, 5), (3, 1), (3, 4096), (100, 4096)):
        got = sorted(map(tuple, runs.run_lengths(df, "v", ["i"], (df.i / width).cast("int"), fanout).select("run", "value", "run_length").collect()))
        assert [g[0] for g in got] == list(range(7)) and [g[1:] for g in got] == [("a", 2), ("b", 3), ("a", 1), ("b", 2), ("a", 1), (None, 2), ("a", 1)]


def test_decode(spark):
    df = spark.createDataFrame([(bytearray(b"\x12\x48"), 4, bytearray([0, 1, 2, 3])), (bytearray(b"\xff"), 2, bytearray([255, 255])), (bytearray(), 0, bytearray()), (None, 1, None), (bytearray(b"\x12"), None, bytearray([255, 0]))], "seq binary, qwidth int, qual binary")
    got = [tuple(r) for r in decode.decode_seqqual(df).select("seq", "qual").collect()]
    assert got == [("ACGT", "!\"#$"), ("NN", "*"), ("", ""), (None, None), (None, "!!")]
    spaces = [r[0] for r in df.select(decode.decode_qual(df.qual, "space")).collect()]
    assert spaces == ["!\"#$", "  ", "", None, " !"]
    with pytest.raises(Exception, match="width"):
        decode.decode_seqqual(spark.createDataFrame([(bytearray(b"\x12"), 3)], "seq binary, qwidth int"), qual=None).collect()
    with pytest.raises(ValueError):
        decode.decode_seqqual(df.select("qual"), qual=None)
    with pytest.raises(ValueError):
        decode.decode_seqqual(df.select("seq"))


def test_cigar(spark):
    df = spark.createDataFrame([("5H30=2X18=",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(cigar.to_text(cigar.parse(df.c))).collect()] == ["5H30=2X18=", "", ""]


def test_resources():
    assert resources.cpu_list_size("0-3,8") == 5 and resources.cpu_list_size("3-1") == 0
    assert resources.parallel_plan(4) == (4, 1) and resources.parallel_plan(4, 8, n_files=2) == (4, 2)
    assert resources.parallel_plan(4, 8, True, 8, cores=16) == (4, 4) and resources.parallel_plan(64, 2, True, 8, cores=8) == (8, 1)
    for bad in (0, "x", True):
        with pytest.raises(ValueError):
            resources.parallel_plan(bad)
    assert [resources.thread_count(x, 8) for x in (4, 0, -1, "x", True, 99)] == [4, 1, 1, 1, 1, 8] and [resources.worker_count(x) for x in (3, 0, "x", None)] == [3, 1, 1, 1]
    assert resources.parallel_plan(4, "x", n_files=9) == (4, 1)
    assert [resources.compression_level(x) for x in (-1, 0, 9, 10)] == [-1, -1, 9, -1]


def tags(*parts):
    return b"".join(parts)


@pytest.fixture(scope="module")
def bam_file(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam") / "x.bam")
    records = []
    for i in range(1500):
        t = b"ASc" + struct.pack("<b", i % 100) + b"RGZg1\0" + b"XXA\0" + b"XHH1AE3\0" + b"XBBI" + struct.pack("<iII", 2, 1234567, 3)
        if i % 3:
            t += b"NMi" + struct.pack("<i", i) + b"XFf" + struct.pack("<f", i / 2) + (b"XMi" + struct.pack("<i", i) if i % 2 else b"XMZs\0")
        records.append({"qname": f"r{i:05d}", "flag": 0, "ref_id": 0, "pos": 10 + i, "mapq": 60 if i else 255, "cigar": "10M", "seq": "ACGTACGTAC", "qual": bytes([40] * 10), "tags": t})
    records.append({"qname": "u", "flag": 4})
    bam.write_bam(path, [("chr1", 100000), ("chr2", 5)], records)
    return path


def test_bam(spark, bam_file, tmp_path):
    header = bam.read_bam_header(spark, bam_file)
    assert [tuple(r) for r in header.orderBy("ref_id").collect()] == [(0, "chr1", 100000), (1, "chr2", 5)]
    df = bam.read_bam(spark, bam_file, tags=["AS", "RG", "NM", "XF", "XM", "XX", "XH", "XB", "ZZ"])
    kinds = dict(df.dtypes)
    assert [kinds[t] for t in ("AS", "RG", "NM", "XF", "XM", "XX", "ZZ")] == ["int", "string", "int", "double", "string", "string", "string"]
    rows = decode.decode_seqqual(df).orderBy("_ord").collect()
    assert len(rows) == 1501 and rows[0]["mapq"] == 255 and rows[3]["seq"] == "ACGTACGTAC" and rows[3]["qual"] == "I" * 10 and rows[3]["NM"] is None
    assert rows[4]["XF"] == 2.0 and rows[5]["XM"] == "5" and rows[4]["XM"] == "s" and rows[4]["XH"] == "1AE3" and rows[4]["XB"] == "1234567,3" and rows[4]["XX"] is None
    assert (rows[-1]["ref_id"], rows[-1]["cigar"], rows[-1]["qwidth"]) == (-1, "", 0)
    assert bam.parse_tags(b"XBBI" + struct.pack("<iI", 1, 1234567), compat=True)["XB"][1] == "1.23457e+06"
    assert df.where("mapq >= 61").count() == 1
    two = bam.read_bam(spark, {"a": bam_file, "b": bam_file}, what=["qname"])
    assert two.columns == ["file", "_ord", "qname", "flag", "ref_id", "pos", "mapq"] and {r[0]: r[1] for r in two.groupBy("file").count().collect()} == {"a": 1501, "b": 1501}
    cut = str(tmp_path / "cut.bam")
    with open(bam_file, "rb") as f, open(cut, "wb") as g:
        g.write(f.read()[:3000])
    with pytest.raises(Exception, match="truncated|ends"):
        bam.read_bam(spark, cut).count()
    with pytest.raises(FileNotFoundError):
        files.named_paths("/nowhere/x.bam")
    with pytest.raises(ValueError):
        files.named_paths([])
    store = str(tmp_path / "store")
    ingest.write_store(bam.read_bam(spark, bam_file), store)
    back = spark.read.parquet(store)
    assert back.where("ref_id = 0 and pos between 100 and 109 and not is_unmapped").count() == 10


def test_bam_in_parts(spark, tmp_path):
    """However a file is cut up, each record is read once and in order; also by an address, and with tags to infer."""
    rng = random.Random(2)
    path = str(tmp_path / "y.bam")
    records = [{"qname": f"r{i}", "flag": rng.choice([0, 4, 16]), "ref_id": rng.randint(-1, 1), "pos": rng.randint(0, 90), "mapq": rng.randint(0, 60), "cigar": "5M", "seq": "".join(rng.choice("ACGT") for _ in range(rng.choice([5, 5, 40, 9000]) if i % 50 == 0 else 5)), "tags": b"NMC" + bytes([i % 200])} for i in range(6000)]
    bam.write_bam(path, [("chr1", 100000), ("chr2", 5)], records)
    size = (tmp_path / "y.bam").stat().st_size
    parts = bam.splits_of(path, 10_000)
    assert len(parts) == -(-size // 10_000) > 10
    whole = bam.read_bam(spark, path, tags=["NM"])
    want = [(r["qname"], r["NM"], len(r["seq"])) for r in whole.orderBy("_ord").collect()]
    assert [w[0] for w in want] == [r["qname"] for r in records] and [w[1] for w in want] == [i % 200 for i in range(6000)]
    for split in (3_000, 10_000, 70_000):
        df = bam.read_bam(spark, "file://" + path, tags=["NM"], split=split)
        assert df.rdd.getNumPartitions() > 1 and [(r["qname"], r["NM"], len(r["seq"])) for r in df.orderBy("_ord").collect()] == want
    assert dict(bam.read_bam(spark, path, tags=["NM"], split=10_000).dtypes)["NM"] == "int"
    empty = str(tmp_path / "empty.bam")
    bam.write_bam(empty, [("chr1", 10)], [])
    assert bam.read_bam(spark, empty).count() == 0


def test_api(spark, bam_file, tmp_path):
    table = api.bam_read(spark, bam_file, what=["qname", "seq", "qual"], tag=["AS"])
    assert table.columns == ["qname", "seq", "qual", "AS"] and table.first()["seq"] == "ACGTACGTAC" and compare.count_records(table) == 1501
    packed = api.bam_read(spark, bam_file, what=["seq"], mode="compact")
    assert dict(packed.dtypes)["seq"] == "binary" and packed.columns == ["seq", "qwidth"]
    two = api.bam_read(spark, {"a": bam_file, "b": bam_file}, output="alignments", what=["mapq"])
    assert list(two) == ["a", "b"] and two["b"].columns == ["rname", "pos", "cigar", "strand", "mapq"] and two["a"].count() == 1500
    with pytest.warns(UserWarning):
        api.bam_read(spark, bam_file, output="alignments", mode="compact")
    regions_ = ScanParam(what=("qname", "pos"), which=(("chr1", 10, 12), ("chr2", 1, 5), ("chr1", 12, 12)))
    scan = api.bam_read(spark, bam_file, regions_, output="scan")
    assert scan.columns == ["batch", "which_label", "qname", "pos"]
    got = sorted(((r["batch"], r["qname"]) for r in scan.collect()), key=str)
    assert got == sorted([(0, "r00000"), (0, "r00001"), (0, "r00002"), (1, None), (2, None)], key=str)
    assert {r["seqname"]: r["count"] for r in api.bam_count(spark, bam_file).collect()} == {"chr1": 1500, "chr2": 0, "*": 1}
    assert set(api.mapq_dist(spark, {"a": bam_file, "b": bam_file})) == {"a", "b"} and api.fragment_sizes(spark, bam_file).collect()[0][:] == (0, 1501)
    out, phases = [str(tmp_path / f"{n}.bw") for n in "ab"], api.Phases()
    made = api.bam_coverage_bigwig(spark, {"a": bam_file, "b": bam_file}, out, phases=phases)
    assert made == {"a": out[0], "b": out[1]} and list(phases.seconds) == ["open", "coverage and write"]
    w = bigwig.BigWig(out[1])
    assert w.summary[3] == 15000 and w.values("chr1", 8, 11).tolist()[1:] == [1.0, 2.0] and coverage.auc(api.bam_coverage(spark, bam_file)).first()[0] == 15000
    w.close()
    for bad in ([out[0]], [out[0], out[0]]):
        with pytest.raises(ValueError):
            api.bam_coverage_bigwig(spark, {"a": bam_file, "b": bam_file}, bad)
    with pytest.raises(ValueError):
        api.bam_read(spark, [bam_file, bam_file])
    pair_file = str(tmp_path / "pairs.bam")
    bam.write_bam(pair_file, CONTIGS[:2], [{"qname": q, "flag": f, "ref_id": 0, "pos": i + 1, "cigar": "4M", "seq": "ACGT"} for i, (q, f) in enumerate([("z", 65), ("z", 129), ("b", 65), ("b", 129), ("b", 129), ("k", 0)])])
    seen = pairs.Observation()
    mates = api.bam_read(spark, pair_file, output="pairs", what=["seq"], seen=seen).collect()
    assert [(r["qname"], r["first_pos"], r["last_pos"], r["first_seq"], r["last_strand"]) for r in mates] == [("b", 3, 4, "ACGT", "+"), ("z", 1, 2, "ACGT", "+")] and seen.get["dropped"] == 1


def test_bigwig(spark, aln, header, tmp_path):
    rng = random.Random(5)
    big = [(n, x * 50) for n, x in CONTIGS]
    rows = [("x", 0, rng.randint(0, 3), rng.randint(1, 4000), 30, "10M", 0, -1, 0, 0) for _ in range(4000)]
    head = spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(big)], header.schema)
    cov = coverage.coverage_runs(spark.createDataFrame(rows, aln.schema), head)
    path = str(tmp_path / "x.bw")
    bigwig.write_bigwig(cov, head, path)
    assert bigwig.is_bigwig(path) and not bigwig.is_bigwig(__file__) and not bigwig.is_bigbed(path)
    w, want = bigwig.BigWig(path), depth(rows, big)
    assert {k: v[1] for k, v in w.contigs.items()} == dict(big) and len(w.zooms) > 1
    for i, (name, n) in enumerate(big):
        got = w.values(name, 0, n) if n else []
        assert [0 if math.isnan(v) else v for v in got] == want[i]
    assert w.summary[3] == sum(map(sum, want.values())) and w.summary[0] == sum(v > 0 for d in want.values() for v in d)
    assert sum(len(b) for b in w.blocks("c1", 10, 2000)) == len(w.intervals("c1", 10, 2000)) and w.intervals("nowhere", 0, 9) == []
    assert w.stats("c1", 0, 5000, 1, "max") == [max(want[0])] and abs(w.stats("c1", 0, 5000, 1, "sum")[0] - sum(want[0])) < 1e-6 * sum(want[0])
    assert math.isnan(w.stats("nowhere", 0, 10)[0]) and w.stats("c1", 100, 104, 1, "mean")[0] == pytest.approx(sum(want[0][100:104]) / sum(v > 0 for v in want[0][100:104]))
    again, serial = str(tmp_path / "y.bw"), str(tmp_path / "z.bw")
    bigwig.write_bigwig(cov.repartition(7), head, again)
    with open(path, "rb") as f, open(again, "rb") as g:
        assert f.read() == g.read()
    w.close()
    s = bigwig.Writer(serial, big)
    rows = sorted((r["ref_id"], r["start"], r["end"], r["value"]) for r in cov.collect() if r["value"] > 0)
    for i, (name, _) in enumerate(big):
        own = [r for r in rows if r[0] == i]
        s.runs(name, [r[1] for r in own], [r[2] for r in own], [r[3] for r in own])
    s.close()
    one, two = bigwig.BigWig(path), bigwig.BigWig(serial)
    assert one.summary == two.summary and all(one.intervals(n, 0, x) == two.intervals(n, 0, x) for n, x in big)


def test_bigwig_kinds(tmp_path):
    """Blocks of every kind, appended to, compressed or not, are read back; so is a file with big-endian numbers and two levels of contigs."""
    for compress in (True, False):
        path = str(tmp_path / f"k{compress}.bw")
        w = bigwig.Writer(path, [("a", 10_000), ("b", 500)], compress=compress)
        w.runs("a", [0, 10], [5, 20], [1.5, 2])
        w.append([3], [30], [31])
        w.starts("a", range(100, 4600, 3), [1.0] * 1500, span=2)
        w.append([7], [5000])
        w.steps("b", 10, [1, 2, 3], step=20, span=10)
        w.append([4, 5])
        with pytest.raises(ValueError):
            w.runs("b", [5], [9], [1])
        w.close()
        r = bigwig.BigWig(path)
        assert r.intervals("a", 4, 31) == [(0, 5, 1.5), (10, 20, 2.0), (30, 31, 3.0)] and len(r.intervals("a", 90, 10_000)) == 1501
        assert r.intervals("b", 0, 500) == [(10, 20, 1.0), (30, 40, 2.0), (50, 60, 3.0), (70, 80, 4.0), (90, 100, 5.0)]
        assert r.summary[0] == 5 + 10 + 1 + 3000 + 2 + 50 and (r.summary[1], r.summary[2]) == (1.0, 7.0)
        assert r.stats("b", 0, 100, 2, "cov") == [0.4, 0.6]
        r.close()
    with pytest.raises(ValueError):
        bigwig.Writer(str(tmp_path / "e.bw"), [("a", 5)]).append([1])
    path = str(tmp_path / "big.bw")
    block = struct.pack(">IIIIIBBH", 1, 2, 4, 0, 0, 1, 0, 1) + struct.pack(">IIf", 2, 4, 2.5)
    tree, head = 64, ">IHHQQQHHQQIQ"
    leaf = lambda n, i: struct.pack(">BBH", 1, 0, 1) + struct.pack(">2sII", n, i, 9)
    nodes = struct.pack(">BBH", 0, 0, 2) + struct.pack(">2sQ2sQ", b"c0", tree + 32 + 24, b"c1", tree + 32 + 24 + 14)
    body = struct.pack(">IIIIQQ", bigwig.TREE_MAGIC, 1, 2, 8, 2, 0) + nodes + leaf(b"c0", 0) + leaf(b"c1", 1)
    data_at = tree + len(body)
    index_at = data_at + 8 + len(block)
    index = struct.pack(">IIQIIIIQII", bigwig.INDEX_MAGIC, 256, 1, 1, 2, 1, 4, index_at, 1, 0) + struct.pack(">BBH", 1, 0, 1) + struct.pack(">IIIIQQ", 1, 2, 1, 4, data_at + 8, len(block))
    with open(path, "wb") as f:
        f.write(struct.pack(head, bigwig.MAGIC, 4, 0, tree, data_at, index_at, 0, 0, 0, 0, 0, 0) + body + struct.pack(">Q", 1) + block + index)
    r = bigwig.BigWig(path)
    assert r.contigs == {"c0": (0, 9), "c1": (1, 9)} and r.intervals("c1", 0, 9) == [(2, 4, 2.5)] and r.intervals("c0", 0, 9) == [] and r.summary is None


def test_bigbed(tmp_path):
    path = str(tmp_path / "x.bb")
    tree, text = 64, b'table t "x" (string c; uint s; uint e; string name;)\0'
    body = struct.pack("<IIIIQQ", bigwig.TREE_MAGIC, 1, 2, 8, 1, 0) + struct.pack("<BBH", 1, 0, 1) + struct.pack("<2sII", b"c1", 0, 99) + text
    rows = b"".join(struct.pack("<III", 0, s, e) + t + b"\0" for s, e, t in ((1, 5, b"one"), (4, 9, b"two\t7"), (20, 30, b"")))
    block = bigwig.zlib.compress(rows)
    data_at = tree + len(body)
    index_at = data_at + 8 + len(block)
    index = struct.pack("<IIQIIIIQII", bigwig.INDEX_MAGIC, 256, 1, 0, 1, 0, 30, index_at, 1, 0) + struct.pack("<BBH", 1, 0, 1) + struct.pack("<IIIIQQ", 0, 1, 0, 30, data_at + 8, len(block))
    with open(path, "wb") as f:
        f.write(bigwig.HEAD.pack(bigwig.BED_MAGIC, 4, 0, tree, data_at, index_at, 4, 3, tree + len(body) - len(text), 0, len(rows), 0) + body + struct.pack("<Q", 3) + block + index)
    r = bigwig.BigWig(path)
    assert r.is_bed and bigwig.is_bigbed(path) and r.fields == 4 and r.autosql().startswith("table t")
    assert list(r.entries("c1", 4, 20)) == [(1, 5, "one"), (4, 9, "two\t7")] and list(r.entries("c2", 0, 9)) == []
    with pytest.raises(ValueError):
        r.intervals("c1", 0, 9)


def test_stream(spark, aln, tmp_path):
    folder = str(tmp_path / "in")
    aln.write.parquet(folder)
    s = stream.running_histogram(stream.alignment_stream(spark, folder, aln.schema), "mapq")
    q = s.writeStream.format("memory").queryName("mapq_stream").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("mapq_stream").collect()} == {tuple(r) for r in aggregate.mapq_dist(aln).collect()}
