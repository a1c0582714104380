"""bigWig files: a writer whose blocks are made and compressed in tasks, and a reader, from the public format description.

Runs are computed once and kept on the executors' disks; they are sorted by range partitions; each task packs its runs into
blocks; the driver appends the compressed blocks in order, one partition at a time, and keeps 24 bytes a block for the index.
Each zoom level is made from the next finer one. `Writer` writes a file by itself, with blocks of all three kinds; `BigWig`
reads files of either byte order, compressed or not, and the entries of bigBed files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators import coverage
from readloom.operators.resources import compression_level
from readloom.sources.files import open_input

MAGIC, BED_MAGIC, TREE_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x8789F2EB, 0x78CA8C91, 0x2468ACE0
RUNS, STARTS, STEPS = 1, 2, 3
"""Kinds of a block: items of start, end and value; of start and value; of values alone."""
ITEMS, FAN, HEAD = 1024, 256, struct.Struct("<IHHQQQHHQQIQ")
ITEM = np.dtype([("start", "<u4"), ("end", "<u4"), ("value", "<f4")])
ZOOM = np.dtype([("ref", "<u4"), ("start", "<u4"), ("end", "<u4"), ("n", "<u4"), ("min", "<f4"), ("max", "<f4"), ("sum", "<f4"), ("sumsq", "<f4")])
BLOCK = "ref_id int, start long, end long, size int, items int, data binary"


def _blocks(level: int, zoom: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(b.num_columns)]
            ref = cols[0]
            rows: list[tuple] = []
            edges = np.flatnonzero(np.concatenate(([True], ref[1:] != ref[:-1], [True]))) if len(ref) else [0]
            for s, e in zip(edges[:-1], edges[1:]):
                for a in range(s, e, ITEMS):
                    z = min(a + ITEMS, e)
                    items = np.zeros(z - a, ZOOM if zoom else ITEM)
                    for name, col in zip(items.dtype.names if zoom else ("", *items.dtype.names), cols):
                        if name:
                            items[name] = col[a:z]
                    head = b"" if zoom else struct.pack("<IIIIIBBH", int(ref[s]), int(cols[1][a]), int(cols[2][z - 1]), 0, 0, 1, 0, z - a)
                    raw = head + items.tobytes()
                    rows.append((int(ref[s]), int(cols[1][a]), int(cols[2][z - 1]), len(raw), z - a, zlib.compress(raw, level)))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, kinds)], ["ref_id", "start", "end", "size", "items", "data"])

    return run


def packed(rows: DataFrame, level: int, zoom: bool) -> DataFrame:
    """Compressed blocks of rows, sorted by contig and start. What a block holds depends on the range partition that it is in."""
    ordered = rows.repartitionByRange(*[F.col(c) for c in rows.columns[:2]]).sortWithinPartitions(*rows.columns[:2])
    return ordered.mapInArrow(_blocks(level, zoom), BLOCK)


def _append(f, rows: DataFrame, level: int, zoom: bool) -> tuple[list[tuple], int, int]:
    """Writes the blocks of sorted rows; (ref, start, end, offset, size) of each, the largest raw size, the number of items."""
    index, most, items = [], 0, 0
    for r in packed(rows, level, zoom).toLocalIterator(prefetchPartitions=True):
        index.append((r["ref_id"], r["start"], r["end"], f.tell(), len(r["data"])))
        f.write(r["data"])
        most, items = max(most, r["size"]), items + r["items"]
    return index, most, items


def _write_index(f, index: list[tuple]) -> int:
    """The R-tree of the blocks, root first; returns where it is."""
    at = f.tell()
    bounds = (index[0][0], index[0][1], *max((x[0], x[2]) for x in index)) if index else (0, 0, 0, 0)
    f.write(struct.pack("<IIQIIIIQII", INDEX_MAGIC, FAN, len(index), *bounds, at, 1, 0))
    levels = [[(x[0], x[1], x[0], x[2], x[3], x[4]) for x in index]]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([(*g[0][:2], *max((x[2], x[3]) for x in g)) for g in (below[i : i + FAN] for i in range(0, len(below), FAN))])
    place = f.tell()
    for depth in range(len(levels) - 1, -1, -1):
        nodes = [levels[depth][i : i + FAN] for i in range(0, len(levels[depth]), FAN)] or [[]]
        size = 4 + FAN * (32 if depth == 0 else 24)
        child = place + len(nodes) * size
        below = 4 + FAN * (32 if depth == 1 else 24)
        for k, node in enumerate(nodes):
            raw = struct.pack("<BBH", depth == 0, 0, len(node))
            for i, x in enumerate(node):
                raw += struct.pack("<IIIIQQ", *x) if depth == 0 else struct.pack("<IIIIQ", *x, child + (k * FAN + i) * below)
            f.write(raw.ljust(size, b"\0"))
        place = child
    return at


def _start(f, contigs: list[tuple[int, str, int]], zooms: int) -> tuple[int, int, int]:
    """Leaves room for the head, zooms and summary, and writes the tree of contigs; where summary, tree and data are."""
    key = max(len(n.encode()) for _, n, _ in contigs)
    f.write(bytes(HEAD.size + 24 * zooms))
    summary_at = f.tell()
    f.write(bytes(40))
    tree_at = f.tell()
    f.write(struct.pack("<IIIIQQ", TREE_MAGIC, len(contigs), key, 8, len(contigs), 0) + struct.pack("<BBH", 1, 0, len(contigs)))
    for i, n, size in sorted(contigs, key=lambda x: x[1].encode()):
        f.write(n.encode().ljust(key, b"\0") + struct.pack("<II", i, size))
    data_at = f.tell()
    f.write(bytes(8))
    return summary_at, tree_at, data_at


def _finish(f, places: tuple[int, int, int], index_at: int, blocks: int, most: int, total: tuple, levels: list[tuple[int, int, int, int]]) -> None:
    """Ends the file and fills in what is known only now; levels: (width, where, where its index is, items)."""
    summary_at, tree_at, data_at = places
    f.write(struct.pack("<I", MAGIC))
    f.seek(summary_at)
    f.write(struct.pack("<Qdddd", *(x or 0 for x in total)))
    f.seek(data_at)
    f.write(struct.pack("<Q", blocks))
    for _, at, _, items in levels:
        f.seek(at)
        f.write(struct.pack("<I", items))
    f.seek(0)
    f.write(HEAD.pack(MAGIC, 4, len(levels), tree_at, data_at, index_at, 0, 0, 0, summary_at, most, 0))
    for w, at, tree, _ in levels:
        f.write(struct.pack("<IIQQ", w, 0, at, tree))


def _contigs(header: DataFrame) -> list[tuple[int, str, int]]:
    contigs = [tuple(r) for r in header.orderBy("ref_id").select("ref_id", "seqname", "seqlength").collect()]
    if not contigs or len(contigs) > 0xFFFF:
        raise ValueError("a bigWig file here has 1 to 65535 contigs")
    return contigs


def write_bigwig(runs: DataFrame, header: DataFrame, path: str, zooms: int = 10, level: int = -1) -> None:
    """Non-zero runs (ref_id, start, end, value) as a bigWig file of version 4; contigs keep the header's order and lengths. A zoom
    level of as many bins as the one before it is left out. Fewer than 0 zooms are 0."""
    level, contigs = compression_level(level), _contigs(header)
    kept = coverage.bedgraph(runs).select("ref_id", "start", "end", "value").persist(StorageLevel.DISK_ONLY)
    lengths = header.select("ref_id", F.col("seqlength").cast("long").alias("len"))
    held = [kept]
    try:
        widths = coverage.zoom_widths(kept, header, max(0, zooms))
        total = tuple(coverage.summary(kept).first())
        with open(path, "wb") as f:
            places = _start(f, contigs, len(widths))
            index, most, _ = _append(f, kept, level, False)
            index_at = _write_index(f, index)
            levels: list[tuple[int, int, int, int]] = []
            finer: tuple[DataFrame, int] | None = None
            for w in widths:
                zoom = (coverage.coarser(finer[0], w // finer[1]) if finer else coverage.zoom_summary(kept, w)).persist(StorageLevel.DISK_ONLY)
                held.append(zoom)
                finer = zoom, w
                if levels and zoom.count() == levels[-1][3]:
                    continue
                z = zoom.join(lengths, "ref_id").select("ref_id", (F.col("zoom_bin") * w).alias("start"), F.least((F.col("zoom_bin") + 1) * w, "len").alias("end"), *coverage.TOTALS)
                at = f.tell()
                f.write(bytes(4))
                zoom_index, size, items = _append(f, z, level, True)
                most = max(most, size)
                levels.append((w, at, _write_index(f, zoom_index), items))
            _finish(f, places, index_at, len(index), most, total, levels)
    finally:
        for x in held:
            x.unpersist()


def write_bigwigs(runs: Mapping[str, DataFrame], headers: Mapping[str, DataFrame], paths: Mapping[str, str] | list[str], zooms: int = 10, level: int = -1) -> dict[str, str]:
    """A file for each of several named runs; as many paths as runs, or an error."""
    if not isinstance(paths, Mapping):
        if len(paths) != len(runs):
            raise ValueError("one output path is needed for each input")
        paths = dict(zip(runs, paths))
    if set(paths) != set(runs) or len(set(paths.values())) != len(runs):
        raise ValueError("one output path is needed for each input")
    for name in runs:
        write_bigwig(runs[name], headers[name], paths[name], zooms, level)
    return dict(paths)


class Writer:
    """A bigWig file without zoom levels, written block by block on the driver: `runs`, `starts` and `steps` add blocks of the three
    kinds, in the order of contigs (which is that of `contigs`) and positions; `append` goes on with the last one's kind."""

    def __init__(self, path: str, contigs: list[tuple[str, int]], level: int = -1, compress: bool = True) -> None:
        self.ids = {n: (i, size) for i, (n, size) in enumerate(contigs)}
        self.f, self.level, self.compress = open(path, "wb"), compression_level(level), compress
        self.places = _start(self.f, [(i, n, size) for n, (i, size) in self.ids.items()], 0)
        self.index: list[tuple] = []
        self.most, self.total, self.last, self.form = 0, (0, None, None, 0.0, 0.0), (-1, 0), None

    def _add(self, kind: int, seqname: str, start: np.ndarray, end: np.ndarray, value: np.ndarray, step: int, span: int) -> None:
        ref, size = self.ids[seqname]
        if not len(start):
            return
        if (ref, int(start[0])) < self.last or (end[:-1] > start[1:]).any() or (start >= end).any() or start[0] < 0 or end[-1] > size:
            raise ValueError("blocks must rise within the contig and not overlap")
        self.last, self.form = (ref, int(end[-1])), (kind, seqname, step, span)
        for a in range(0, len(start), ITEMS):
            z = min(a + ITEMS, len(start))
            items = np.zeros(z - a, ITEM)
            items["start"], items["end"], items["value"] = start[a:z], end[a:z], value[a:z]
            body = items if kind == RUNS else items[["start", "value"]] if kind == STARTS else items["value"]
            body = np.ascontiguousarray(body if kind != STARTS else np.rec.fromarrays([items["start"], items["value"]], dtype=[("start", "<u4"), ("value", "<f4")]))
            raw = struct.pack("<IIIIIBBH", ref, int(start[a]), int(end[z - 1]), step, span, kind, 0, z - a) + body.tobytes()
            data = zlib.compress(raw, self.level) if self.compress else raw
            self.index.append((ref, int(start[a]), int(end[z - 1]), self.f.tell(), len(data)))
            self.f.write(data)
            self.most = max(self.most, len(raw) if self.compress else 0)
        n, (bases, low, high, total, squares) = (end - start).astype(np.float64), self.total
        v = value.astype(np.float64)
        self.total = (bases + int(n.sum()), min(v.min(), v.min() if low is None else low), max(v.max(), v.max() if high is None else high), total + float((v * n).sum()), squares + float((v * v * n).sum()))

    def runs(self, seqname: str, start: Iterable[int], end: Iterable[int], value: Iterable[float]) -> None:
        self._add(RUNS, seqname, *(np.asarray(x, np.int64) for x in (start, end)), np.asarray(value, np.float64), 0, 0)

    def starts(self, seqname: str, start: Iterable[int], value: Iterable[float], span: int) -> None:
        at = np.asarray(start, np.int64)
        self._add(STARTS, seqname, at, at + span, np.asarray(value, np.float64), 0, span)

    def steps(self, seqname: str, start: int, value: Iterable[float], step: int, span: int) -> None:
        v = np.asarray(value, np.float64)
        at = start + step * np.arange(len(v))
        self._add(STEPS, seqname, at, at + span, v, step, span)

    def append(self, value: Iterable[float], start: Iterable[int] = (), end: Iterable[int] = ()) -> None:
        """More items of the last kind, contig, step and span; steps go on where they ended."""
        if self.form is None:
            raise ValueError("nothing to append to")
        kind, seqname, step, span = self.form
        if kind == RUNS:
            self.runs(seqname, start, end, value)
        elif kind == STARTS:
            self.starts(seqname, start, value, span)
        else:
            self.steps(seqname, self.last[1] - span + step, value, step, span)

    def close(self) -> None:
        if not self.f.closed:
            _finish(self.f, self.places, _write_index(self.f, self.index), len(self.index), self.most, self.total, [])
            self.f.close()


def _magic(path: str) -> int | None:
    with open_input(path) as f:
        raw = f.read(4)
    return next((m for m in (MAGIC, BED_MAGIC) if raw in (struct.pack("<I", m), struct.pack(">I", m))), None)


def is_bigwig(path: str) -> bool:
    return _magic(path) == MAGIC


def is_bigbed(path: str) -> bool:
    return _magic(path) == BED_MAGIC


class BigWig:
    """A bigWig or bigBed file that is open for reading, from any file system that pyarrow opens."""

    def __init__(self, path: str) -> None:
        self.f = open_input(path)
        raw = self.f.read(HEAD.size)
        kinds = {struct.pack(o + "I", m): (o, m) for o in "<>" for m in (MAGIC, BED_MAGIC)}
        if raw[:4] not in kinds:
            raise ValueError("neither a bigWig nor a bigBed file")
        self.order, magic = kinds[raw[:4]]
        self.is_bed = magic == BED_MAGIC
        h = struct.unpack(self.order + "IHHQQQHHQQIQ", raw)
        self.version, self.tree_at, self.data_at, self.index_at, self.fields, self.autosql_at, self.summary_at, self.buffer = h[1], h[3], h[4], h[5], h[6], h[8], h[9], h[10]
        self.zooms = [self._read("IIQQ") for _ in range(h[2])]
        self.summary = self._read("Qdddd", self.summary_at) if self.summary_at else None
        self.contigs: dict[str, tuple[int, int]] = {}
        magic, _, key, _, _, _ = self._read("IIIIQQ", self.tree_at)
        if magic != TREE_MAGIC:
            raise ValueError("a file without a tree of contigs")
        self._contigs(self.f.tell(), key)

    def _read(self, form: str, at: int | None = None) -> tuple:
        if at is not None:
            self.f.seek(at)
        form = self.order + form
        return struct.unpack(form, self.f.read(struct.calcsize(form)))

    def _contigs(self, at: int, key: int) -> None:
        leaf, _, n = self._read("BBH", at)
        if leaf:
            for _ in range(n):
                name, ref, size = self._read(f"{key}sII")
                self.contigs[name.rstrip(b"\0").decode()] = ref, size
        else:
            for child in [self._read(f"{key}sQ")[1] for _ in range(n)]:
                self._contigs(child, key)

    def autosql(self) -> str | None:
        """The text that describes a bigBed file's fields."""
        if not self.autosql_at:
            return None
        self.f.seek(self.autosql_at)
        text = b""
        while b"\0" not in text and (more := self.f.read(4096)):
            text += more
        return text.split(b"\0")[0].decode()

    def close(self) -> None:
        self.f.close()

    def _found(self, at: int, ref: int, start: int, end: int) -> Iterator[tuple[int, int]]:
        leaf, _, n = self._read("BBH", at)
        form = self.order + ("IIIIQQ" if leaf else "IIIIQ")
        for x in struct.iter_unpack(form, self.f.read(n * struct.calcsize(form))):
            if (x[0], x[1]) < (ref, end) and (x[2], x[3]) > (ref, start):
                if leaf:
                    yield x[4], x[5]
                else:
                    yield from self._found(x[4], ref, start, end)

    def _block(self, at: int, size: int) -> bytes:
        self.f.seek(at)
        raw = self.f.read(size)
        return zlib.decompress(raw) if self.buffer else raw

    def _items(self, raw: bytes, ref: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end, value of a block's items; none if it is of another contig."""
        own, first, _, step, span, kind, _, n = struct.unpack_from(self.order + "IIIIIBBH", raw)
        if own != ref:
            return (np.zeros(0, np.int64),) * 3
        o = self.order
        if kind == RUNS:
            x = np.frombuffer(raw, np.dtype([("s", o + "u4"), ("e", o + "u4"), ("v", o + "f4")]), n, 24)
            return x["s"].astype(np.int64), x["e"].astype(np.int64), x["v"]
        if kind == STARTS:
            x = np.frombuffer(raw, np.dtype([("s", o + "u4"), ("v", o + "f4")]), n, 24)
            return x["s"].astype(np.int64), x["s"].astype(np.int64) + span, x["v"]
        if kind == STEPS:
            at = first + step * np.arange(n, dtype=np.int64)
            return at, at + span, np.frombuffer(raw, o + "f4", n, 24)
        raise ValueError(f"a block of unknown kind {kind}")

    def blocks(self, seqname: str, start: int, end: int) -> Iterator[list[tuple[int, int, float]]]:
        """The stored runs that overlap a 0-based half-open range, block by block."""
        if self.is_bed:
            raise ValueError("a bigBed file has entries, not runs")
        if seqname not in self.contigs:
            return
        ref, _ = self.contigs[seqname]
        for at, size in list(self._found(self.index_at + 48, ref, start, end)):
            s, e, v = self._items(self._block(at, size), ref)
            hit = (e > start) & (s < end)
            if hit.any():
                yield list(zip(s[hit].tolist(), e[hit].tolist(), v[hit].tolist()))

    def intervals(self, seqname: str, start: int, end: int) -> list[tuple[int, int, float]]:
        """Stored runs that overlap a 0-based half-open range; none on an unknown contig."""
        return [x for b in self.blocks(seqname, start, end) for x in b]

    def values(self, seqname: str, start: int, end: int) -> np.ndarray:
        """A value per base of the range, NaN where nothing is stored."""
        out = np.full(end - start, np.nan)
        for s, e, v in self.intervals(seqname, start, end):
            out[max(s, start) - start : min(e, end) - start] = v
        return out

    def zoom_bins(self, level: int, seqname: str, start: int, end: int) -> list[tuple]:
        """(start, end, bases, min, max, sum, sum of squares) of a zoom level's bins that overlap the range."""
        ref, _ = self.contigs[seqname]
        kind = np.dtype([(n, self.order + ZOOM[n].str[1:]) for n in ZOOM.names])
        out = []
        for at, size in list(self._found(self.zooms[level][3] + 48, ref, start, end)):
            x = np.frombuffer(self._block(at, size), kind)
            out += [tuple(r)[1:] for r in x[(x["ref"] == ref) & (x["end"] > start) & (x["start"] < end)].tolist()]
        return out

    def stats(self, seqname: str, start: int, end: int, n_bins: int = 1, stat: str = "mean") -> list[float]:
        """A statistic of each of n_bins bins of the range, from the widest zoom level of at most half a bin, or else from the runs."""
        edges = [start + (end - start) * i // n_bins for i in range(n_bins + 1)]
        fit = [i for i, z in enumerate(self.zooms) if 2 * z[0] <= (end - start) / n_bins]
        if fit and seqname in self.contigs:
            rows = np.array([(s, e, n, lo, hi, t, q) for s, e, n, lo, hi, t, q in self.zoom_bins(fit[-1], seqname, start, end)], np.float64).reshape(-1, 7)
        else:
            rows = np.array([(s, e, e - s, v, v, v * (e - s), v * v * (e - s)) for s, e, v in self.intervals(seqname, start, end)], np.float64).reshape(-1, 7)
        out = []
        for a, z in zip(edges, edges[1:]):
            share = (np.minimum(rows[:, 1], z) - np.maximum(rows[:, 0], a)) / np.maximum(rows[:, 1] - rows[:, 0], 1)
            hit, share = rows[share > 0], share[share > 0]
            bases, total, squares = ((hit[:, c] * share).sum() for c in (2, 5, 6))
            if not bases or (stat == "std" and bases <= 1):
                out.append(float("nan"))
                continue
            made = {"mean": lambda: total / bases, "sum": lambda: total, "min": lambda: hit[:, 3].min(), "max": lambda: hit[:, 4].max(), "cov": lambda: bases / (z - a), "std": lambda: np.sqrt(max(0.0, (squares - total * total / bases) / (bases - 1)))}
            out.append(float(made[stat]()))
        return out

    def entries(self, seqname: str, start: int, end: int) -> Iterator[tuple[int, int, str]]:
        """(start, end, the other fields joined by tabs) of a bigBed file's entries that overlap the range."""
        if not self.is_bed:
            raise ValueError("a bigWig file has runs, not entries")
        if seqname not in self.contigs:
            return
        ref, _ = self.contigs[seqname]
        for at, size in list(self._found(self.index_at + 48, ref, start, end)):
            raw, i = self._block(at, size), 0
            while i + 12 <= len(raw):
                own, s, e = struct.unpack_from(self.order + "III", raw, i)
                stop = raw.index(b"\0", i + 12)
                if own == ref and e > start and s < end:
                    yield s, e, raw[i + 12 : stop].decode()
                i = stop + 1
