"""One call from files to a result: a DataFrame for one file, and for several a dictionary of them by name."""

from __future__ import annotations

import logging
import time
import warnings
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from readloom.functions.decode import decode_seqqual
from readloom.functions.params import ScanParam
from readloom.operators import aggregate, coverage, pairs, project, regions
from readloom.sources import bam, bigwig
from readloom.sources.files import named_paths

log = logging.getLogger("readloom")
OUTPUTS = ("table", "scan", "alignments", "pairs")


class Phases:
    """Seconds by phase, in order; logged as they end if verbose."""

    def __init__(self, verbose: bool = False) -> None:
        self.verbose, self.seconds = verbose, {}

    @contextmanager
    def __call__(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began
            if self.verbose:
                log.info("%s: %.3f s", name, self.seconds[name])


def each_file(files, run: Callable[[str, str], object]):
    """run(name, path) of one file, or of each of several by name."""
    found = named_paths(files)
    if len({n for n, _ in found}) < len(found):
        raise ValueError("several files of one name; give them names of their own")
    made = {n: run(n, p) for n, p in found}
    return made if len(made) > 1 or isinstance(files, Mapping) else next(iter(made.values()))


def _raw(spark: SparkSession, name: str, path: str, fields: Iterable[str], tags: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    needs = {"mrnm": ("mate_ref_id", "mpos"), "rname": (), "strand": ()}
    what = [c for f in fields for c in needs.get(f, (f,))]
    return bam.read_bam(spark, {name: path}, what, list(tags)), bam.read_bam_header(spark, path)


def bam_read(spark: SparkSession, files, param: ScanParam | None = None, what: Iterable[str] | None = None, tag: Iterable[str] | None = None, output: str = "table", mode: str = "compatible", seen: Observation | None = None):
    """Records of BAM files. `what` and `tag` go before those of param.

    output: `table`, a row a record; `scan`, the records of each region with batch and which_label, an empty region being a row of
    nulls; `alignments`, mapped records with their implied fields; `pairs`, mates side by side, sorted by name. mode `compact` leaves
    bases and qualities packed, in a table. seen receives what `pairs` drops."""
    if output not in OUTPUTS:
        raise ValueError(f"output is one of {OUTPUTS}")
    if mode not in ("compatible", "compact"):
        raise ValueError("mode is 'compatible' or 'compact'")
    if mode == "compact" and output != "table":
        warnings.warn(f"compact mode has no output {output}; compatible mode is used", stacklevel=2)
        mode = "compatible"
    p = param or ScanParam()
    p = replace(p, **({"what": tuple(what)} if what else {}), **({"tag": tuple(tag)} if tag else {}))
    extra = (*p.what, *p.tags) if output in ("alignments", "pairs") else ()
    fields = list(dict.fromkeys([*project.IMPLIED[output], *p.what])) if extra or output in ("alignments", "pairs") else p.fields
    packed = [f for f in ("seq", "qual") if f in fields]

    def text(df: DataFrame) -> DataFrame:
        return df if mode == "compact" or not packed else decode_seqqual(df)

    def one(name: str, path: str) -> DataFrame:
        raw, header = _raw(spark, name, path, [*fields, *(["qname", "flag"] if output == "pairs" else [])], p.tags)
        if output == "alignments":
            return project.mapped_alignments(text(raw), header, p, extra)
        if output == "pairs":
            full = project.with_fields(text(raw), header).withColumn("__at", F.col("_ord"))
            return pairs.mate_pairs(full, ["__at"], [f for f in [*fields, *p.tags] if f != "qname"], p, ordered=True, seen=seen)
        if output == "table":
            width = ["qwidth"] if mode == "compact" and "seq" in packed and "qwidth" not in fields else []
            return project.scan(text(raw), header, replace(p, what=(*fields, *width)))
        if not p.which:
            return project.scan(text(raw), header, p).select(F.lit(0).alias("batch"), F.lit(None).cast("string").alias("which_label"), "*")
        kept = text(raw).where(p.flag_predicate())
        return project.with_fields(regions.region_batches(kept, header, p.which), header).select("batch", "which_label", *p.fields, *p.tags)

    return each_file(files, one)


def bam_count(spark: SparkSession, files, param: ScanParam | None = None):
    return each_file(files, lambda n, path: aggregate.count_by_contig(*_raw(spark, n, path, (), ()), param))


def fragment_sizes(spark: SparkSession, files, param: ScanParam | None = None, drop_mate_unmapped: bool = True):
    return each_file(files, lambda n, path: aggregate.fragment_sizes(_raw(spark, n, path, ["isize"], ())[0], param, drop_mate_unmapped))


def mapq_dist(spark: SparkSession, files, param: ScanParam | None = None):
    return each_file(files, lambda n, path: aggregate.mapq_dist(_raw(spark, n, path, (), ())[0], param))


def bam_coverage(spark: SparkSession, files, param: ScanParam | None = None):
    return each_file(files, lambda n, path: coverage.coverage_runs(*_raw(spark, n, path, ["cigar"], ()), param))


def bam_coverage_bigwig(spark: SparkSession, files, outfiles, param: ScanParam | None = None, zooms: int = 10, level: int = -1, phases: Phases | None = None) -> dict[str, str]:
    """A bigWig file of each file's coverage; one output path a file, or an error."""
    phases = phases or Phases()
    with phases("open"):
        found = named_paths(files)
        outfiles = [outfiles] if isinstance(outfiles, str) else outfiles
        raw = {n: _raw(spark, n, path, ["cigar"], ()) for n, path in found}
        if len(raw) < len(found):
            raise ValueError("several files of one name; give them names of their own")
        runs = {n: coverage.coverage_runs(*x, param) for n, x in raw.items()}
    with phases("coverage and write"):
        return bigwig.write_bigwigs(runs, {n: h for n, (_, h) in raw.items()}, outfiles, zooms, level)
