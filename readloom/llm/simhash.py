"""SimHash near-dedup by tiled exact comparison.

A fingerprint's bit is 1 if over half of the XXH64 hashes (seed 42) of the 3-word shingles have it. Fingerprints that
differ in at most 3 bits are linked; documents of one connected component are one group.

Two fingerprints within 3 bits agree in one of four 16-bit quarters and, in the other 48 bits, in one of four 12-bit
parts; so each distinct fingerprint goes under 16 keys, and only fingerprints of one key are compared: in tiles, by numpy
exclusive-or and bit counts, in order of population count, skipping tile pairs whose counts are over 3 apart. A key of
more than HOT fingerprints is dealt out as pairs of slices, so that no task holds more than two of them. Each task
returns a spanning forest of the links it found, never all pairs.

Null and empty texts and texts without words have fingerprint 0 and are linked like any other. Repeated rows give
repeated result rows; rows of one id and different texts are different documents, which may be in different groups. A null id is kept in its row and is no candidate for component_id unless a group has no other. An
empty table gives an empty result. Only the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import as_bytes, bounded, components, cut, tidy, unite, version

RADIUS, SEED, SHINGLE, TILE, HOT = 3, 42, 3, 512, 20_000


def fingerprint(text: bytes) -> int:
    """The unsigned fingerprint of one text."""
    ws = text.lower().split()
    if not ws:
        return 0
    shingles = map(b" ".join, zip(*(ws[i:] for i in range(SHINGLE)))) if len(ws) >= SHINGLE else [b" ".join(ws)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 255 * 256):
        part = hashes[at : at + 255 * 256]
        full = np.zeros(-(-len(part) // 255) * 255, np.uint64)
        full[: len(part)] = part
        bits = np.unpackbits(full.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([fingerprint(x) for x in as_bytes(b.column(0))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found, pa.int64())], [*b.schema.names[1:], "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, version (of the text), fp (the fingerprint as a signed long)."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    return rows.select("text", "doc_id", version("text").alias("version")).mapInArrow(tidy(_fingerprints), "doc_id long, version long, fp long")


def tile_links(fps: np.ndarray, parent: np.ndarray) -> None:
    """Unites in parent all of fps (uint64) that differ in at most RADIUS bits, tile by tile."""
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    fps, counts = fps[order], np.bitwise_count(fps[order]).astype(int)
    for a in range(0, len(fps), TILE):
        top = counts[min(a + TILE, len(fps)) - 1]
        for b in range(a, len(fps), TILE):
            if counts[b] - top > RADIUS:
                break
            i, j = np.nonzero(np.bitwise_count(fps[a : a + TILE, None] ^ fps[None, b : b + TILE]) <= RADIUS)
            if a == b:
                i, j = i[i < j], j[i < j]
            unite(parent, order[a + i], order[b + j])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: spanning edges within each key. What is carried over is the last key's rows only."""

    def solve(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        parent = np.arange(len(fp))
        sizes = np.diff(cuts)
        small = np.repeat(sizes <= 32, sizes)
        group = np.repeat(np.arange(len(sizes)), sizes)
        bare = fp.view(np.uint64)
        for shift in range(1, 32):  # tiles of neighbouring small groups, all at once
            near = small[shift:] & (group[shift:] == group[:-shift])
            if not near.any():
                break
            i = np.flatnonzero(near)
            i = i[np.bitwise_count(bare[i] ^ bare[i + shift]) <= RADIUS]
            unite(parent, i, i + shift)
        for s, e in zip(cuts[:-1][sizes > 32], cuts[1:][sizes > 32]):
            own = np.arange(e - s)
            tile_links(bare[s:e], own)
            parent[s:e] = own + s
        i = np.flatnonzero(parent != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[i], pa.int64()), pa.array(fp[parent[i]], pa.int64())], ["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for b in batches:
        key, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        if not len(key):
            continue
        held.append((key, fp))
        rows += len(key)
        if rows < 50_000 and rows < 3 * HOT:
            continue
        key, fp = (np.concatenate(x) for x in zip(*held))
        last = np.searchsorted(key, key[-1]) if key[0] != key[-1] else 0
        if last:
            yield solve(key[:last], fp[:last])
        held, rows = [(key[last:], fp[last:])], len(key) - last
    if held:
        yield solve(*(np.concatenate(x) for x in zip(*held)))


def _keys(fps: DataFrame) -> DataFrame:
    """(key, fp): the 16 keys of each fingerprint: which quarter and part, and their bits."""
    fp = F.col("fp")
    keys = []
    for q in range(4):
        quarter = F.shiftrightunsigned(fp, 16 * q).bitwiseAND(0xFFFF)
        rest = F.shiftrightunsigned(fp, 16 * (q + 1)) if q < 3 else F.lit(0).cast("long")
        rest = F.shiftleft(rest, 16 * q).bitwiseOR(fp.bitwiseAND((1 << 16 * q) - 1)) if q else rest
        for p in range(4):
            part = F.shiftrightunsigned(rest, 12 * p).bitwiseAND(0xFFF)
            keys.append(F.lit(4 * q + p).cast("long") * (1 << 28) + quarter * (1 << 12) + part)
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Spanning links (u, v) between the distinct fingerprints of fps(fp)."""
    keyed = _keys(fps).select(F.col("key").cast("long"), "fp")
    large = cut(keyed.groupBy("key").count().where(F.col("count") > hot), "hot-keys")
    if not large.isEmpty():
        wide = keyed.join(bounded(large), "key", "left").withColumn("n", F.ceil(F.coalesce("count", F.lit(0)) * 2 / hot).cast("int"))
        slice_ = F.pmod(F.xxhash64("fp"), F.greatest("n", F.lit(1))).cast("int")
        other = F.explode(F.when(F.col("n") > 1, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array(F.lit(-1))))
        wide = wide.withColumn("s", slice_).select("*", other.alias("o"))
        keyed = wide.select(F.when(F.col("o") < 0, F.col("key")).otherwise(F.xxhash64("key", F.least("s", "o"), F.greatest("s", "o"))).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_links), "u long, v long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, version (of the text), fingerprint (16 hex digits), component_id: the smallest id reachable over links; and root, the
    component's own number, as rows of one id may be in different components of the same smallest id.

    Only fingerprints that are linked or repeated need a component by join; for any other it is the id itself."""
    prints = cut(fingerprints(docs, id_col, text_col), "fingerprints")
    least = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = cut(components(links(least.select("fp"), hot)), "roots")
    linked = least.join(bounded(roots), F.col("fp") == F.col("node")).select("fp", "root", "least")
    whole = cut(linked.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    placed = linked.join(bounded(whole), "root").select("fp", "root", "component_id")
    alone = least.where("n > 1").join(bounded(roots.select("node")), F.col("fp") == F.col("node"), "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    known = cut(placed.unionByName(alone), "placed").withColumnRenamed("fp", "__fp").withColumn("__in", F.lit(True))
    rows = prints.join(bounded(known), F.col("fp") == F.col("__fp"), "left")
    component = F.when(F.col("__in"), F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "version", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"), F.coalesce("root", "fp").alias("root"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("version", "root")
