"""Best-fit packing with certified bin counts.

Documents become token ids and an end id (distinct words are merged together by the replay of `bytebpe`, and words out of the
ordinary or with the string of a special token by the tokenizer itself, just as the file says); longer ones are cut into pieces of the capacity, the last being shorter. Pieces
are dealt to partitions and each is packed by best-fit decreasing. Dual-feasible functions give a lower bound of the bins
that a partition's pieces need; where it equals the bins used, the partition is certified and done. The partitions with
a gap exchange documents: what lies in their bins that are not full, and in the emptiest bin of the others, is dealt anew
to half as many partitions or fewer and packed again, until no bin is open or one partition is left. Full bins stay. Partitions hold PART pieces on average, however
large the input, so a task's memory is bounded; the last round's single partition begins only when at most PART
pieces are open, and otherwise open pieces stay as they are packed once rounds bring no fewer bins.

A null or empty text is the end id alone. Repeated rows are packed like any other rows, and pieces are dealt by their place in
the table too, so that equal rows do not meet in one partition. A null id is kept. An empty
table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.bytebpe import NUMBER, Pairs, classes, gather, replay
from readloom.llm.common import as_bytes, blocks, cut, gathered, segment_hashes, tidy, words

CAPACITY, END_ID, PART = 4096, 1, 50_000
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", part long, round int, bin long, offset long, filled long, gap int, tail boolean"


@lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


PLAIN = np.array([0x20 < c < 0x250 and c not in (0x27, 0x7F, 0x130) and not 0x80 <= c <= 0xA0 and c != 0xAD for c in range(0x251)])
"""Code points whose lower case is one code point and that are normal as they are; no white space, control or apostrophe."""


@lru_cache(2)
def word_merges(path: str) -> tuple[Pairs, np.ndarray, np.ndarray] | None:
    """The merges of a byte-level BPE file with word ends, and the tokens of a byte within and at the end of a piece; None if
    the file is not of the kind whose tokens are numbered in the order of their merges and whose pieces are known here."""
    with open(path) as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
    steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = [x.get("pattern", {}).get("Regex") for x in before.get("pretokenizers", [])]
    if model["type"] != "BPE" or not end or steps != ["NFC", "Replace", "Lowercase"] or splits != [WORD_PATTERN, None]:
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
    char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocab[a + b] for a, b in merges]
    if any(x >= y for x, y in zip(made, made[1:])):
        return None
    pairs = Pairs([(vocab[a], vocab[b], m) for (a, b), m in zip(merges, made)], len(vocab) + 2)
    return pairs, np.array([vocab[char[b]] for b in range(256)], np.int32), np.array([vocab[char[b] + end] for b in range(256)], np.int32)


class WordIds:
    """Ids of the words of texts. White space always separates what this kind of tokenizer joins, so each distinct word between
    ASCII white space is tokenized once a task, and occurrences find it by hash, length and sum of bytes."""

    KNOWN = 1 << 19

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = word_merges(path)
        self.forget()

    def _new(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of words, one after another, and how many each has. Words of plain Latin letters, digits and marks are merged
        together; any other goes through the tokenizer."""
        plain = np.zeros(len(texts), bool)
        if self.merges is not None and texts:
            cp = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
            ends = np.flatnonzero(cp == 10)
            odd = ~PLAIN[np.minimum(cp, 0x250)]
            odd[ends] = False
            plain = np.diff(np.concatenate(([0], np.cumsum(odd)[ends]))) == 0
            plain &= ~np.array([any(x in t for x in self.special) for t in texts], bool)
        got = self.tokenizer.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False)
        sizes = np.zeros(len(texts), np.int64)
        sizes[~plain] = [len(g.ids) for g in got]
        rest = np.fromiter((x for g in got for x in g.ids), np.uint32, int(sizes.sum()))
        if not plain.any():
            return rest, sizes
        ids, counts = self._merge([t for t, p in zip(texts, plain) if p])
        sizes[plain] = counts
        out = np.zeros(int(sizes.sum()), np.uint32)
        which = np.repeat(plain, sizes)
        out[which], out[~which] = ids, rest
        return out, sizes

    def _merge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pairs, inner, last = self.merges
        joined = "\n".join([*texts, ""]).lower()
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind, wall = classes()[cp], cp == 10
        data = np.frombuffer(joined.encode(), np.uint8)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        new = np.ones(len(cp), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) | wall[:-1]
        owner = (np.cumsum(wall) - wall)[new & ~wall]
        marks = lead[new]
        sizes = np.diff(np.append(marks, len(data)))[~wall[new]]
        begins = np.concatenate(([0], np.cumsum(sizes)))
        data = data[data != 10]
        sym = inner[data]
        sym[begins[1:] - 1] = last[data[begins[1:] - 1]]
        ids, place = replay(pairs, sym, begins, lambda i: self.tokenizer.encode(data[begins[i] : begins[i + 1]].tobytes().decode(), add_special_tokens=False).ids)
        return ids.astype(np.uint32), np.bincount(owner, np.diff(place), len(texts)).astype(np.int64)

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.at = self.size = self.bytes = self.sums = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _split(self, texts: list[bytes]) -> tuple:
        """The words of a block: where each text's begin, the distinct hashes, which each word has, lengths and sums; and the new ones."""
        cuts = np.cumsum([0, *map(len, texts)])
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts, ends = words(data, cuts)
        total = np.concatenate(([0], np.cumsum(data, dtype=np.int64)))
        length, sums = (ends - starts).astype(np.int32), total[ends] - total[starts]
        found, first, of = np.unique(segment_hashes(data, starts, ends), return_index=True, return_inverse=True)
        to = np.searchsorted(self.hashes, found)
        new = np.append(self.hashes, np.uint64(0))[to] != found
        new[to == len(self.hashes)] = True
        i, raw = first[new], data.tobytes()
        fresh = (found[new], length[i], sums[i], [raw[s:e] for s, e in zip(starts[i].tolist(), ends[i].tolist())])
        return np.searchsorted(starts, cuts), found, of.astype(np.int32), length, sums, fresh

    def _learn(self, fresh: list[tuple]) -> None:
        """Merges the words that blocks have found new, all together."""
        found, first = np.unique(np.concatenate([x[0] for x in fresh]), return_index=True)
        if not len(found):
            return
        texts = [t for x in fresh for t in x[3]]
        got, sizes = self._new([texts[i].decode() for i in first.tolist()])
        to, at = np.searchsorted(self.hashes, found), len(self.ids) + np.cumsum(sizes) - sizes
        self.ids, self.hashes = np.concatenate((self.ids, got)), np.insert(self.hashes, to, found)
        for name, x in (("at", at), ("size", sizes), ("bytes", np.concatenate([x[1] for x in fresh])[first]), ("sums", np.concatenate([x[2] for x in fresh])[first])):
            setattr(self, name, np.insert(getattr(self, name), to, x))

    def encode(self, parts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each block of texts: the ids of all, one after another, and each text's place in them."""
        if len(self.hashes) > self.KNOWN:
            self.forget()
        split = [self._split(texts) for texts in parts]
        self._learn([x[-1] for x in split])
        for texts, (bounds, found, of, length, sums, _) in zip(parts, split):
            of = np.searchsorted(self.hashes, found)[of]
            sizes = self.size[of]
            end = np.concatenate(([0], np.cumsum(sizes)))
            if (self.bytes[of] != length).any() or (self.sums[of] != sums).any():  # two words of one hash
                plain = [self.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in texts]
                yield np.array([x for p in plain for x in p], np.uint32), np.cumsum([0, *map(len, plain)])
            else:
                yield gather(self.ids, self.at[of], sizes), end[bounds]


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    """What a worker process knows; later tasks go on with it."""
    return WordIds(path)


def _pieces(path: str, capacity: int, end_id: int):
    def cut_up(docs: pa.Array, flat: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        n = len(docs)
        begins = place + np.arange(n + 1)  # with an end id after each document
        ids = np.full(begins[-1], end_id, "<u4")
        inner = np.ones(len(ids), bool)
        inner[begins[1:] - 1] = False
        ids[inner] = flat
        many = -(-np.diff(begins) // capacity)
        doc = np.repeat(np.arange(n), many)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        start = piece * capacity
        size = np.minimum(np.diff(begins)[doc] - start, capacity)
        raw, at = memoryview(ids.tobytes()), 4 * (begins[doc] + start)
        crc = [zlib.crc32(raw[a:z]) for a, z in zip(at.tolist(), (at + 4 * size).tolist())]
        return pa.RecordBatch.from_arrays([docs.take(pa.array(doc)), *(pa.array(x, k) for x, k in ((piece, pa.int32()), (start, pa.int64()), (size, pa.int64()), (crc, pa.int64())))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path)
        for group in gathered(batches):
            parts = [(b.column(0)[s:e], texts[s:e]) for b in group for texts in [as_bytes(b.column(1))] for s, e in blocks([len(t) for t in texts])]
            for (docs, _), (flat, place) in zip(parts, known.encode([t for _, t in parts])):
                yield cut_up(docs, flat, place)

    return run


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(_pieces(path, capacity, end_id)), PIECE)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest of the bounds by dual-feasible functions: the sum; sizes over capacity - k as whole bins with those under k
    left out; and sizes rounded by x -> floor((p + 1) x / capacity) / p where that is no whole number."""
    if not len(lengths):
        return 0
    hist = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((hist * size).sum()) // capacity)
    count, total = np.cumsum(hist), np.cumsum(hist * size)
    for k in range(1, capacity // 2 + 1):
        big = int(count[-1] - count[capacity - k])
        mid = int(total[capacity - k] - total[k - 1])
        best = max(best, big + -(-mid // capacity))
    for p in range(1, 101):
        scaled = (p + 1) * size
        f = np.where(scaled % capacity == 0, size * p, (scaled // capacity) * capacity)  # times p * capacity
        best = max(best, -(-int((hist * f).sum()) // (p * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece, and its offset there."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by the room left
    some = 0  # bit r is set if a bin has room r
    used = 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        if fits := some >> n:
            r = n + ((fits & -fits).bit_length() - 1)
            k = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            r, k, used = capacity, used, used + 1
        bins[i], offsets[i] = k, capacity - r
        if r > n:
            if not room[r - n]:
                some |= 1 << (r - n)
            room[r - n].append(k)
    return bins, offsets


def _pack(capacity: int):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        lengths = p["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        filled = np.bincount(bins, lengths).astype(np.int64)
        p["bin"], p["offset"], p["filled"], p["gap"] = bins, offsets, filled[bins], len(filled) - lower_bound(lengths, capacity)
        p["tail"] = bins == int(filled.argmin())
        return p[[x.split()[0] for x in PLACED.split(", ")]]

    return run


def pack(found: DataFrame, capacity: int = CAPACITY, part: int = PART, keep: str = "sequence_id") -> DataFrame:
    """found (PIECE) with sequence_id and offset, and certified: whether the partition's bins equal the lower bound."""
    parts = max(1, -(-found.count() // part))
    open_, done, number, last = found, [], 0, None
    while True:
        key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(number)), F.lit(parts))
        dealt = open_.select(*[x.split()[0] for x in PIECE.split(", ")], key.cast("long").alias("part"), F.lit(number).alias("round"))
        packed = cut(dealt.groupBy("part").applyInPandas(_pack(capacity), PLACED), "packed")
        again = ((F.col("gap") > 0) | F.col("tail")) & (F.col("filled") < capacity)
        state = packed.where(again).agg(F.countDistinct("part", "bin").alias("bins"), F.count("*").alias("open"), F.countDistinct("part").alias("parts")).first()
        if parts == 1 or not state["parts"] or (last is not None and state["bins"] >= last and state["open"] > part):
            done.append(packed)
            break
        done.append(packed.where(~again))
        open_, last, number = packed.where(again), state["bins"], number + 1
        parts = max(1, min(-(-state["open"] // part), -(-state["parts"] // 2)))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    number_of = (F.col("round").cast("long") * (1 << 56)) + F.col("part") * (1 << 24) + F.col("bin")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", number_of.alias(keep), "offset", (F.col("gap") == 0).alias("certified"))


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, part: int = PART) -> DataFrame:
    return pack(cut(pieces(docs, path, id_col, text_col, capacity, end_id), "pieces"), capacity, part)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
