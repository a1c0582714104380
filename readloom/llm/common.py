"""What the operators share: the shared scratch folder, written cuts of lineage, text blocks, components."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
"""Bytes of text that one numpy pass takes; a longer document is a block of its own."""
ROWS = 1500
"""Rows that a function over batches sees at once."""
BROADCAST_BYTES = 16 << 20
"""Estimated bytes up to which a counted table of numbers is broadcast; beyond it Spark joins by shuffle."""
WIDTHS = {"int": 4, "long": 8, "bigint": 8, "boolean": 1, "double": 8}


def scratch(spark: SparkSession) -> str:
    """This application's folder in the one that the driver and all executors share. Only a local session (tests) may name none;
    it gets one. The folder goes when the driver ends."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "readloom-scratch")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/readloom-{spark.sparkContext.applicationId}"
    if path not in _SWEPT:
        _SWEPT.add(path)
        atexit.register(_remove, spark, path)
    return path


_SWEPT: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone, and its files are the cluster's to clean
        pass


def sweep(spark: SparkSession) -> None:
    """Deletes what this application's queries have written; their results must not be read afterwards."""
    _remove(spark, scratch(spark))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that lost executors cost no recomputation."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if df, whose rows are a few numbers each, is counted to be small; df itself otherwise."""
    most = most_bytes // (24 + sum(WIDTHS.get(t, 64) for _, t in df.dtypes))
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def version(text: str | Column = "text") -> Column:
    """What tells the different texts of one id apart."""
    return F.xxhash64(text)


def as_bytes(texts: pa.Array) -> list[bytes]:
    return [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in texts.to_pylist()]


def blocks(sizes: list[int], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows whose sizes add up to at most `most`, or one row."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def gathered(batches: Iterator[pa.RecordBatch], most: int = 4 * BLOCK_BYTES, column: int = 1) -> Iterator[list[pa.RecordBatch]]:
    """Neighbouring batches whose texts add up to `most` bytes or little more, or one batch."""
    group, total = [], 0
    for b in batches:
        group.append(b)
        total += b.column(column).nbytes
        if total >= most:
            yield group
            group, total = [], 0
    if group:
        yield group


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Powers:
    """Powers of an odd base and of its inverse, modulo 2**64, as far as they have been asked for."""

    base = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK_BYTES + 4096)
            made = []
            for b in (self.base, pow(self.base, -1, 1 << 64)):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                made.append(np.multiply.accumulate(x))
            self.up, self.down = made
        return self.up, self.down


POWERS = Powers()


def release() -> None:
    """Gives memory that a finished task no longer uses back to the system, as Python workers are kept for later tasks."""
    POWERS.up = POWERS.down = np.ones(1, np.uint64)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run over a partition's batches, in slices of ROWS rows (Spark bounds a batch's bytes), then `release`."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS))
        finally:
            release()

    return tidied


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], from one running sum over all bytes."""
    up, down = POWERS.to(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts])


def words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space and tab to carriage return; cuts: where documents start, and the end."""
    solid = np.zeros(len(data) + 1, bool)
    solid[:-1] = (data != 32) & ((data < 9) | (data > 13))
    first = np.zeros(len(data) + 1, bool)
    first[cuts] = True
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (first | ~before))
    ends = np.flatnonzero(before & (first | ~solid))
    return starts, ends


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j; parent holds every element's smallest member before and after."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges(u, v): root is the smallest node reachable.

    Large-star and small-star rounds over DataFrames, until the edges are stars: every node but the centres has one edge,
    which leads to a centre. Each round's edges are written to the shared folder. A hub's edges stream through a sum and a
    join whose skew Spark splits; no node's neighbours are gathered.
    """
    def order(e: DataFrame) -> DataFrame:
        return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def both(e: DataFrame, *more: str) -> DataFrame:
        return e.select("u", "v", *[F.lit(1).alias(m) for m in more]).unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), *[F.lit(0).alias(m) for m in more]))

    now = cut(order(edges.select("u", "v")), "edges")
    while True:
        ends = both(now, "out").groupBy("u").agg(F.sum("out").alias("out"), F.max(1 - F.col("out")).alias("centre"))
        if ends.where("out > 1 or (out = 1 and centre = 1)").isEmpty():
            break
        low = both(now).groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = order(both(now).join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = cut(order(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))), "edges")
    low = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return low.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
