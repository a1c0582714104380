"""BAM files as a Spark data source, from the public format specification.

`spark.read.format("bam")` with options `paths` (JSON list of [name, path]), `what` (comma-separated fields to decode),
`tags` (comma-separated NAME:int|double|string) and `split` (compressed bytes of a partition). A file is dealt out by ranges
of its bytes: a partition has the records that start in the blocks which start in its range. It finds the first block by its
header and checksum, and the first record as the first place from which records that fit the header's contigs follow one
another. Blocks stream through a bounded buffer. Truncated or malformed files are errors. `_ord` is a record's virtual
offset: the place of its block, times 65536, plus its place in the block.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition

from readloom.sources.files import named_paths, open_input

OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
RAW = {
    "file": "string", "_ord": "long", "qname": "string", "flag": "int", "ref_id": "int", "pos": "int", "mapq": "int", "cigar": "string",
    "mate_ref_id": "int", "mpos": "int", "isize": "int", "qwidth": "int", "seq": "binary", "qual": "binary",
}
ALWAYS = ("file", "_ord", "flag", "ref_id", "pos", "mapq")
NEEDS = {"rname": ("ref_id",), "strand": ("flag", "ref_id"), "mrnm": ("mate_ref_id",), "seq": ("seq", "qwidth")}
BATCH, SPLIT, READ, CHAIN = 20_000, 64 << 20, 1 << 20, 16
"""Records of a batch; compressed bytes of a partition, and of one read; records that must follow one another to be taken for such."""
INTS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
KINDS = {"int": 1, "double": 2, "string": 3}
ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}


class Corrupt(ValueError):
    """A file that does not follow the format."""


MAGIC = b"\x1f\x8b\x08\x04"


def block_size(raw: bytes, at: int) -> int:
    """The size of the BGZF block at raw[at:]; 0 if its head is not all there, -1 if it is none."""
    if len(raw) - at < 12:
        return 0
    if raw[at : at + 4] != MAGIC:
        return -1
    end = at + 12 + struct.unpack_from("<H", raw, at + 10)[0]
    if len(raw) < end:
        return 0
    x = at + 12
    while x + 4 <= end:
        n = struct.unpack_from("<H", raw, x + 2)[0]
        if raw[x : x + 2] == b"BC" and n == 2:
            return struct.unpack_from("<H", raw, x + 4)[0] + 1
        x += 4 + n
    return -1


def inflate(raw: bytes, at: int, size: int) -> bytes:
    head = 12 + struct.unpack_from("<H", raw, at + 10)[0]
    try:
        data = zlib.decompress(raw[at + head : at + size - 8], -15)
    except zlib.error as e:
        raise Corrupt(f"a BGZF block that cannot be inflated: {e}") from e
    if (zlib.crc32(data), len(data)) != struct.unpack_from("<II", raw, at + size - 8):
        raise Corrupt("a BGZF block whose checksum or size is wrong")
    return data


def inflated(f: pa.NativeFile, at: int) -> Iterator[tuple[int, bytes]]:
    """The place and contents of each BGZF block from the one at `at`."""
    f.seek(at)
    raw, i = b"", 0
    while True:
        size = block_size(raw, i)
        if size < 0:
            raise Corrupt("not a BGZF block")
        if not size or len(raw) - i < size:
            more = f.read(READ)
            if not more:
                if len(raw) > i:
                    raise Corrupt("truncated BGZF block")
                return
            raw, at, i = raw[i:] + more, at + i, 0
            continue
        yield at + i, inflate(raw, i, size)
        i += size


def first_block(f: pa.NativeFile, start: int, end: int) -> int | None:
    """The place of the first BGZF block that starts in [start, end)."""
    f.seek(start)
    raw, i = f.read(min(end - start, READ) + (1 << 17)), -1
    while (i := raw.find(MAGIC, i + 1)) >= 0 and start + i < end:
        size = block_size(raw, i)
        if size > 0 and len(raw) - i >= size:
            try:
                inflate(raw, i, size)
                return start + i
            except Corrupt:
                continue
    return None


class Stream:
    """A file's inflated bytes from a block on: `need(n)` makes n of them available at `at` in `data`, or says that there are none."""

    def __init__(self, f: pa.NativeFile, start: int = 0) -> None:
        self.blocks, self.data, self.at = inflated(f, start), b"", 0
        self.places, self.begins = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def need(self, n: int) -> bool:
        if len(self.data) - self.at >= n:
            return True
        parts, have = [self.data[self.at :]], len(self.data) - self.at
        last = max(0, int(np.searchsorted(self.begins, self.at, side="right")) - 1)
        places, begins = self.places[last:].tolist(), (self.begins[last:] - self.at).tolist()
        while have < max(n, READ) and (b := next(self.blocks, None)) is not None:
            if b[1]:
                places.append(b[0])
                begins.append(have)
                parts.append(b[1])
                have += len(b[1])
        self.data, self.at = b"".join(parts), 0
        self.places, self.begins = np.array(places, np.int64), np.array(begins, np.int64)
        if have < n and have:
            raise Corrupt("the file ends within a record")
        return have >= n

    def take(self, n: int) -> bytes:
        if not self.need(n):
            raise Corrupt("the file ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def virtual(self, at: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.begins, at, side="right") - 1
        return (self.places[block] << 16) + (at - self.begins[block])


def starts_of(data: bytes, n_refs: int) -> np.ndarray:
    """Places where a record of such a file may start, by its fixed fields alone."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw) - 36
    if n <= 0:
        return np.zeros(0, np.int64)
    long = lambda at: (raw[at : at + n].astype(np.int64) | raw[at + 1 : at + 1 + n].astype(np.int64) << 8 | raw[at + 2 : at + 2 + n].astype(np.int64) << 16 | raw[at + 3 : at + 3 + n].view(np.int8).astype(np.int64) << 24)
    size, ref, pos, l_seq, mate, mpos = (long(x) for x in (0, 4, 8, 20, 24, 28))
    name = raw[12 : 12 + n].astype(np.int64)
    cigar = raw[16 : 16 + n].astype(np.int64) | raw[17 : 17 + n].astype(np.int64) << 8
    fine = (size >= 33) & (ref >= -1) & (ref < n_refs) & (mate >= -1) & (mate < n_refs) & (pos >= -1) & (mpos >= -1) & (name >= 1) & (l_seq >= 0)
    fine &= 32 + name + 4 * cigar + (l_seq + 1) // 2 + l_seq <= size
    at = np.flatnonzero(fine)
    end = at + 36 + name[at] - 1
    inside = end < len(raw)
    return at[~inside | (raw[np.minimum(end, len(raw) - 1)] == 0)]


def first_record(s: Stream, n_refs: int) -> bool:
    """Moves s to the first record that starts in what it has or will have; False if there is none."""
    want = READ
    while s.need(1):
        ended = False
        try:
            s.need(want)
        except Corrupt:  # less than that is left
            ended = True
        data = s.data[s.at :]
        maybe = starts_of(data, n_refs)
        known = set(maybe.tolist())
        for at in maybe.tolist():
            i = at
            for seen in range(1, CHAIN + 1):
                i += 4 + int.from_bytes(data[i : i + 4], "little")
                if i == len(data) and ended or seen == CHAIN and i < len(data):
                    s.at += at
                    return True
                if i not in known:
                    break
        if ended:
            return False
        want *= 2
    return False


def record_batches(path: str, start: int, end: int, first: int, n_refs: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(data, where its records begin after their size, their virtual offsets) of the records that start in blocks of [start, end).
    first: the virtual offset of the file's first record."""
    with open_input(path) as f:
        if start <= first >> 16 < end:
            s = Stream(f, first >> 16)
            if not s.need(1):
                return
            s.at = first & 0xFFFF
        elif start <= first >> 16 or (block := first_block(f, start, end)) is None:
            return
        else:
            s = Stream(f, block)
            if not first_record(s, n_refs):
                return
        while s.need(4):
            places, at, held = [], s.at, len(s.data)
            while len(places) < BATCH and at + 4 <= held:
                size = int.from_bytes(s.data[at : at + 4], "little", signed=True)
                if size < 32:
                    raise Corrupt("a record of impossible size")
                if at + 4 + size > held:
                    break
                places.append(at + 4)
                at += 4 + size
            if not places:
                if s.virtual(np.array([s.at]))[0] >> 16 >= end:
                    return
                s.need(4 + int.from_bytes(s.data[s.at : s.at + 4], "little"))
                continue
            where = np.array(places)
            order = s.virtual(where - 4)
            own = int(np.searchsorted(order >> 16, end))
            if own:
                yield s.data, where[:own], order[:own]
            if own < len(where):
                return
            s.at = at


def splits_of(path: str, split: int = SPLIT) -> list[tuple[int, int, int, int]]:
    """(start, end, first, n_refs) of each range of a file, as record_batches takes them."""
    with open_input(path) as f:
        s = Stream(f)
        n_refs = len(read_header(s))
        if not s.need(1):
            return []
        first, size = int(s.virtual(np.array([s.at]))[0]), f.size()
    return [(x, min(x + split, size), first, n_refs) for x in range(0, size, split)]


def read_header(s: Stream) -> list[tuple[str, int]]:
    if s.take(4) != b"BAM\x01":
        raise Corrupt("not a BAM file")
    s.take(struct.unpack("<i", s.take(4))[0])
    out = []
    for _ in range(struct.unpack("<i", s.take(4))[0]):
        name = s.take(struct.unpack("<i", s.take(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", s.take(4))[0]))
    return out


def number_text(x: float, compat: bool) -> str:
    return f"{x:g}" if compat else (str(x) if isinstance(x, int) else repr(x))


def parse_tags(raw: bytes, compat: bool = False) -> dict[str, tuple[str, object]]:
    """Tag -> (type code, value). A character NUL is null; arrays are joined by commas, with all digits or, as `compat`, six."""
    out: dict[str, tuple[str, object]] = {}
    at = 0
    try:
        while at < len(raw):
            tag, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
            at += 3
            if kind in INTS:
                out[tag] = (kind, struct.unpack_from(INTS[kind], raw, at)[0])
                at += struct.calcsize(INTS[kind])
            elif kind == "f":
                out[tag] = (kind, struct.unpack_from("<f", raw, at)[0])
                at += 4
            elif kind == "A":
                out[tag] = (kind, chr(raw[at]) if raw[at] else None)
                at += 1
            elif kind in "ZH":
                end = raw.index(b"\0", at)
                out[tag] = (kind, raw[at:end].decode())
                at = end + 1
            elif kind == "B":
                sub, n = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)[0]
                form = "<f" if sub == "f" else INTS[sub]
                size = struct.calcsize(form)
                values = struct.unpack_from(f"<{n}{form[1]}", raw, at + 5)
                out[tag] = (kind, ",".join(number_text(v, compat) for v in values))
                at += 5 + n * size
            else:
                raise Corrupt(f"unknown tag type {kind!r}")
    except (struct.error, IndexError, KeyError, ValueError) as e:
        raise Corrupt(f"malformed tags: {e}") from e
    return out


def tag_kind(code: str, value: object) -> int:
    """Rank of a value's type: 1 int, 2 double (also integers beyond 31 bits), 3 string."""
    return (2 if abs(value) > 2**31 - 1 else 1) if code in INTS else 2 if code == "f" else 3


class Decoder:
    """Records of one file as Arrow batches of the asked columns."""

    def __init__(self, columns: dict[str, str], tags: dict[str, str], name: str, min_mapq: int = 0, compat: bool = False) -> None:
        self.columns, self.tags, self.name, self.min_mapq, self.compat = columns, tags, name, min_mapq, compat
        self.cigars: dict[bytes, str] = {b"": ""}

    def cigar(self, raw: bytes) -> str:
        if (text := self.cigars.get(raw)) is None:
            if len(self.cigars) > 1 << 18:
                self.cigars = {b"": ""}
            ops = struct.unpack(f"<{len(raw) // 4}I", raw)
            text = self.cigars[raw] = "".join(f"{x >> 4}{OPS[x & 15] if x & 15 < 9 else '?'}" for x in ops)
        return text

    def batch(self, data: bytes, at: np.ndarray, order: np.ndarray) -> pa.RecordBatch:
        raw = np.frombuffer(data, np.uint8)
        fixed = raw[at[:, None] + np.arange(-4, 32)]
        f = np.ascontiguousarray(fixed).view(np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("mref", "<i4"), ("mpos", "<i4"), ("tlen", "<i4")]))[:, 0]
        if self.min_mapq:
            keep = f["mapq"] >= self.min_mapq
            f, at, order = f[keep], at[keep], order[keep]
        l_seq = f["l_seq"].astype(np.int64)
        name = at + 32
        cig = name + f["l_name"]
        seq = cig + 4 * f["n_cigar"].astype(np.int64)
        qual = seq + (l_seq + 1) // 2
        tags = qual + l_seq
        end = at + f["size"]
        if ((l_seq < 0) | (tags > end) | (f["l_name"] < 1)).any():
            raise Corrupt("a record whose parts do not fit it")
        cut = lambda a, z: [data[i:j] for i, j in zip(a.tolist(), z.tolist())]
        n = len(f)
        make = {
            "file": lambda: [self.name] * n, "_ord": lambda: order, "qname": lambda: [x.decode() for x in cut(name, cig - 1)], "flag": lambda: f["flag"].astype(np.int32),
            "ref_id": lambda: f["ref"], "pos": lambda: f["pos"].astype(np.int64) + 1, "mapq": lambda: f["mapq"].astype(np.int32), "cigar": lambda: [self.cigar(x) for x in cut(cig, seq)],
            "mate_ref_id": lambda: f["mref"], "mpos": lambda: f["mpos"].astype(np.int64) + 1, "isize": lambda: f["tlen"], "qwidth": lambda: f["l_seq"],
            "seq": lambda: cut(seq, qual), "qual": lambda: cut(qual, tags),
        }
        cols = [pa.array(make[c](), ARROW[t]) for c, t in self.columns.items() if c in make]
        if self.tags:
            got = [parse_tags(x, self.compat) for x in cut(tags, end)]
            for tag, kind in self.tags.items():
                values = [g[tag][1] if tag in g else None for g in got]
                if kind == "string":
                    values = [None if v is None else v if isinstance(v, str) else number_text(v, False) for v in values]
                cols.append(pa.array([None if v is None else float(v) for v in values] if kind == "double" else values, ARROW[kind]))
        return pa.RecordBatch.from_arrays(cols, [*self.columns, *self.tags])


class BamReader(DataSourceReader):
    def __init__(self, paths: list, columns: dict[str, str], tags: dict[str, str], compat: bool, split: int) -> None:
        self.paths, self.columns, self.tags, self.compat, self.split = paths, columns, tags, compat, split
        self.min_mapq, self.file = 0, None

    def pushFilters(self, filters):
        """mapq >= t and file = x are applied here, exactly; the others are given back."""
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("mapq",):
                self.min_mapq = max(self.min_mapq, int(f.value))
            elif isinstance(f, EqualTo) and f.attribute == ("file",) and self.file in (None, f.value):
                self.file = f.value
            else:
                yield f

    def partitions(self):
        return [InputPartition((n, p, *x)) for n, p in self.paths if self.file in (None, n) for x in splits_of(p, self.split)] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        name, path, *where = partition.value
        decoder = Decoder(self.columns, self.tags, name, self.min_mapq, self.compat)
        for data, at, order in record_batches(path, *where):
            yield decoder.batch(data, at, order)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def _parts(self) -> tuple[list, dict[str, str], dict[str, str]]:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else named_paths(self.options["path"])
        what = [w for w in self.options.get("what", "").split(",") if w] or list(RAW)
        wanted = {*ALWAYS, *(c for w in what for c in NEEDS.get(w, (w,)))}
        tags = dict(t.split(":") for t in self.options.get("tags", "").split(",") if t)
        if unknown := wanted - set(RAW):
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        if bad := set(tags.values()) - set(KINDS):
            raise ValueError(f"unknown tag types: {sorted(bad)}")
        return paths, {c: t for c, t in RAW.items() if c in wanted}, tags

    def schema(self) -> str:
        _, columns, tags = self._parts()
        return ", ".join(f"`{c}` {t}" for c, t in (columns | tags).items())

    def reader(self, schema) -> BamReader:
        return BamReader(*self._parts(), self.options.get("compat_format", "false") == "true", int(self.options.get("split", SPLIT)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)


def read_bam(spark: SparkSession, files, what: Iterable[str] = (), tags: dict[str, str] | Iterable[str] = (), split: int = SPLIT) -> DataFrame:
    """Raw records of BAM files with file and _ord (their order). Tags without a given type are inferred by a pass over the files."""
    register(spark)
    pairs = named_paths(files)
    if not isinstance(tags, dict):
        tags = infer_tags(spark, pairs, [t for t in dict.fromkeys(tags) if t], split)
    options = {"paths": json.dumps(pairs), "what": ",".join(what), "tags": ",".join(f"{k}:{v}" for k, v in tags.items()), "split": str(split)}
    return spark.read.format("bam").options(**options).load()


def tag_places(data: bytes, at: np.ndarray) -> Iterator[bytes]:
    """The tags of each record, encoded."""
    for i in at.tolist():
        size, l_name = int.from_bytes(data[i - 4 : i], "little"), data[i + 8]
        n_cigar, l_seq = struct.unpack_from("<H", data, i + 12)[0], struct.unpack_from("<i", data, i + 16)[0]
        yield data[i + 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq : i + size]


def infer_tags(spark: SparkSession, pairs: list[tuple[str, str]], tags: list[str], split: int = SPLIT) -> dict[str, str]:
    """The widest type of each tag over all records: int, double or string; a tag that never occurs is a string."""
    if not tags:
        return {}
    wanted = set(tags)

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                best: dict[str, int] = {}
                for data, at, _ in record_batches(row["path"], row["start"], row["end"], row["first"], row["refs"]):
                    for raw in tag_places(data, at):
                        for tag, (code, value) in parse_tags(raw).items():
                            if tag in wanted and value is not None:
                                best[tag] = max(best.get(tag, 0), tag_kind(code, value))
                yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.string()), pa.array(list(best.values()), pa.int32())], ["tag", "kind"])

    parts = [(p, *x) for _, p in pairs for x in splits_of(p, split)]
    if not parts:
        return dict.fromkeys(tags, "string")
    rows = spark.createDataFrame(parts, "path string, start long, end long, first long, refs int").repartition(len(parts)).mapInArrow(kinds, "tag string, kind int").groupBy("tag").agg({"kind": "max"}).collect()
    found, names = dict(map(tuple, rows)), {v: k for k, v in KINDS.items()}
    return {t: names[found.get(t, 3)] for t in tags}


def header_of(path: str) -> list[tuple[str, int]]:
    """(name, length) of a file's contigs; none is an error."""
    with open_input(path) as f:
        contigs = read_header(Stream(f))
    if not contigs:
        raise Corrupt("a BAM file without contigs")
    return contigs


def header_frame(spark: SparkSession, contigs: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(contigs)], "ref_id int, seqname string, seqlength int")


def read_bam_header(spark: SparkSession, path: str) -> DataFrame:
    """ref_id, seqname, seqlength."""
    return header_frame(spark, header_of(path))


def bgzf(data: bytes) -> bytes:
    """data as BGZF blocks and the end marker."""
    out = []
    for s in [*range(0, len(data), 0xFF00), None]:
        part = b"" if s is None else data[s : s + 0xFF00]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out.append(struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def encode_record(r: dict) -> bytes:
    """One record from raw columns: seq as text, qual as bytes, tags as encoded bytes."""
    name = r["qname"].encode() + b"\0"
    ops, n = [], 0
    for ch in r.get("cigar", ""):
        if ch.isdigit():
            n = 10 * n + int(ch)
        else:
            ops.append(n << 4 | OPS.index(ch))
            n = 0
    seq = r.get("seq", "")
    codes = [BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    qual = r.get("qual", b"\xff" * len(seq))
    body = struct.pack("<iiBBHHHiiii", r.get("ref_id", -1), r.get("pos", 0) - 1, len(name), r.get("mapq", 0), 0, len(ops), r.get("flag", 0), len(seq), r.get("mate_ref_id", -1), r.get("mpos", 0) - 1, r.get("isize", 0))
    body += name + struct.pack(f"<{len(ops)}I", *ops) + packed + qual + r.get("tags", b"")
    return struct.pack("<i", len(body)) + body


def write_bam(path: str, contigs: list[tuple[str, int]], records: Iterable[dict]) -> None:
    """A small BAM file, as tests and fixtures need."""
    text = "".join(f"@SQ\tSN:{n}\tLN:{x}\n" for n, x in contigs).encode()
    head = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs))
    head += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", x) for n, x in contigs)
    with open(path, "wb") as f:
        f.write(bgzf(head + b"".join(map(encode_record, records))))
