"""Byte-level BPE by corpus-level merge replay.

The rows of a task are cut into blocks, whose pieces (matches of the pattern) are made distinct. All merges run together over
the pieces of many blocks that the worker process has not seen before; what it knows is kept for its later tasks. An inverted index leads from a token pair, by the rank of the token it makes, to the
positions where it stands; merges are applied in rank order, each at all its positions at once, and only the two
neighbours of a merged position are looked up anew. Where a merge makes a pair of lower rank than itself, the order of
the steps within one piece would matter, so such pieces are done again one by one; the result is that of the tiktoken
library. Ids are decoded by a gather from the vocabulary's bytes, and a document that does not come back byte for byte
(two pieces of one 64-bit hash) is encoded again piece by piece.

A null text counts as empty: 0 ids. Lone surrogates cannot occur in Spark strings. Repeated rows give repeated result
rows; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import BLOCK_BYTES, as_bytes, blocks, gathered, segment_hashes, tidy

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
NONE = np.iinfo(np.int32).max
KNOWN = 1 << 19
"""Distinct pieces whose ids a worker process keeps; beyond it, it starts anew."""


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point under the pattern: \\p{L}, \\p{N}, \\s or none of them."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, which in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(which, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            table[a : b + 1] = kind
    return table


class Pairs:
    """Which token each pair of tokens makes; tokens are numbered in the order of their merges."""

    def __init__(self, merges: list[tuple[int, int, int]], n: int) -> None:
        self.n = n
        merges = sorted((a * n + b, c) for a, b, c in merges)
        self.keys = np.array([k for k, _ in merges] or [-1], np.int64)
        self.made = np.array([c for _, c in merges] or [NONE], np.int32)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair makes, or NONE."""
        key = a.astype(np.int64) * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], np.int32(NONE))


class Vocabulary:
    """The ranks of a tiktoken file, as arrays."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.tokens = {r: t for t, r in self.ranks.items()}
        n = max(self.tokens) + 1
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.sizes = np.array([len(self.tokens.get(i, b"")) for i in range(n)], np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.sizes)))
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(n)), np.uint8)
        self.pairs = Pairs([(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks], n)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of pieces that earlier blocks had, sorted
        self.known_at = self.known_size = np.zeros(0, np.int64)
        self.known_ids = np.zeros(0, np.int32)

    def one_by_one(self, piece: bytes) -> list[int]:
        """The least-rank merge of one piece, again and again."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 200:
            return self._long(piece)
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _long(self, piece: bytes) -> list[int]:
        n = len(piece)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(self.ranks[piece[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if piece[i : i + 2] in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or j >= n or end[j] != k:
                continue
            end[i], end[j] = k, -1
            if k < n:
                before[k] = i
                if (r := self.ranks.get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, k, end[k]))
            if (p := before[i]) >= 0 and (r := self.ranks.get(piece[p:k])) is not None:
                heapq.heappush(heap, (r, p, i, k))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def replay(v: Pairs, sym: np.ndarray, begins: np.ndarray, alone: Callable[[int], list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """ids of all pieces, one after another, and each piece's place in them. A piece is sym[begins[i]:begins[i + 1]], tokens of
    single bytes, which are overwritten; alone(i) encodes a piece by itself."""
    n = len(sym)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(begins), np.int64)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)  # 32 bits are enough for a group of blocks
    word = np.repeat(np.arange(len(begins) - 1, dtype=np.int32), np.diff(begins))
    live = np.ones(n, bool)
    redo: set[int] = set()
    due = np.full(n, NONE, np.int32)  # the token that the pair beginning here makes
    for s in range(0, n, BLOCK_BYTES):
        at = s + np.flatnonzero(word[s + 1 : s + BLOCK_BYTES + 1] == word[s : s + BLOCK_BYTES][: len(word) - s - 1])
        due[at] = v.rank_of(sym[at], sym[at + 1])
    index: dict[int, list[np.ndarray]] = {}

    def note(at: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1]))).tolist()
        for s, e in zip(cuts, [*cuts[1:], len(at)]):
            r = int(ranks[s])
            if r not in index:
                index[r] = []
                heapq.heappush(heap, r)
            index[r].append(at[s:e])

    heap: list[int] = []
    can = np.flatnonzero(due != NONE).astype(np.int32)
    if len(can):
        note(can, due[can])
    ends = begins[1:].astype(np.int32)[word]
    while heap:
        r = heapq.heappop(heap)
        at = index.pop(r)
        at = np.sort(np.concatenate(at)) if len(at) > 1 else at[0]
        at = at[live[at] & (due[at] == r)]
        if len(at) > 1:
            if (again := at[1:] == at[:-1]).any():
                at = at[np.concatenate(([True], ~again))]
            chained = after[at[:-1]] == at[1:]
            if chained.any():  # of touching pairs every other one, from the left
                run = np.concatenate(([0], np.cumsum(~chained)))
                first = np.flatnonzero(np.concatenate(([True], ~chained)))
                at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        nxt = after[gone]
        live[gone] = False
        sym[at] = r
        after[at] = nxt
        here = nxt < ends[at]
        before[nxt[here]] = at[here]
        due[at] = NONE
        right = at[here]
        due[right] = v.rank_of(sym[right], sym[after[right]])
        left = before[at]
        left = left[(left >= 0) & (word[np.maximum(left, 0)] == word[at])]
        due[left] = v.rank_of(sym[left], sym[after[left]])
        new = np.concatenate((left, right))
        ranks = due[new]
        if (bad := ranks < r).any():
            redo.update(word[new[bad]].tolist())
        can = ranks != NONE
        if can.any():
            note(new[can], ranks[can])
    ids, kept = sym[live], word[live]
    place = np.searchsorted(kept, np.arange(len(begins)))
    if redo:
        parts = np.split(ids, place[1:-1])
        for w in redo:
            parts[w] = np.array(alone(w), np.int64)
        place = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        ids = np.concatenate(parts)
    return ids, place


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches flat[start:start + size], one after another."""
    to = np.cumsum(sizes)
    total = int(to[-1]) if len(to) else 0
    return flat[np.repeat(starts - (to - sizes), sizes) + np.arange(total)]


def piece_starts(text: str, cuts: np.ndarray) -> np.ndarray:
    """Where pieces start in the joined text, by classes of code points; for texts without an apostrophe that a letter follows."""
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = classes()[cp]
    n = len(kind)
    first = np.zeros(n + 1, bool)
    first[cuts] = True
    first = first[:n]
    new = first.copy()
    new[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # The last white space before something else stands alone, or goes with it if it is a space.
    tail = np.zeros(n, bool)
    tail[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    glued = np.zeros(n, bool)
    glued[1:] = tail[:-1] & (cp[:-1] == 32)
    return np.flatnonzero((new | tail) & ~glued)


def split_block(v: Vocabulary, texts: list[bytes]) -> tuple:
    """The pieces of a block, by text: their distinct hashes, which each has, how many a text has; and the hashes and bytes of the new ones."""
    strings = [t.decode() for t in texts]
    plain = [regex.search(r"'(?:[stmd]|re|ve|ll)", s) is None for s in strings]
    joined = "".join(s for s, p in zip(strings, plain) if p)
    chars = np.cumsum([0, *(len(s) for s, p in zip(strings, plain) if p)])
    char_starts = piece_starts(joined, chars) if joined else np.zeros(0, np.int64)
    data = np.frombuffer(joined.encode(), np.uint8)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    starts = lead[char_starts]
    own = np.flatnonzero(plain)[np.searchsorted(chars, char_starts, side="right") - 1] if len(char_starts) else char_starts
    odd = [(i, [m.encode() for m in v.pattern.findall(strings[i])]) for i in np.flatnonzero(~np.array(plain, bool))]
    extra = b"".join(b"".join(p) for _, p in odd)
    if extra:
        sizes = np.array([len(x) for _, p in odd for x in p])
        starts = np.concatenate((starts, len(data) + np.cumsum(sizes) - sizes))
        own = np.concatenate((own, np.repeat([i for i, _ in odd], [len(p) for _, p in odd])))
        data = np.concatenate((data, np.frombuffer(extra, np.uint8)))
    ends = np.append(starts[1:], len(data))[: len(starts)]
    hashes, at, of = np.unique(segment_hashes(data, starts, ends), return_index=True, return_inverse=True)
    to = np.searchsorted(v.known, hashes)
    new = np.append(v.known, np.uint64(0))[to] != hashes
    new[to == len(v.known)] = True
    at = at[new]
    sizes = ends[at] - starts[at]
    if extra:
        of = of[np.argsort(own, kind="stable")]
    return hashes, of.astype(np.int32), np.bincount(own, minlength=len(texts)), hashes[new], gather(data, starts[at], sizes), sizes


def learn(v: Vocabulary, split: list[tuple]) -> None:
    """Replays the merges over all pieces that blocks have found new."""
    hashes, first = np.unique(np.concatenate([x[3] for x in split]), return_index=True)
    if not len(hashes):
        return
    data, sizes = np.concatenate([x[4] for x in split]), np.concatenate([x[5] for x in split])
    pieces = gather(data, (np.cumsum(sizes) - sizes)[first], sizes[first])
    begins = np.concatenate(([0], np.cumsum(sizes[first])))
    ids, place = replay(v.pairs, v.byte_ids[pieces], begins, lambda i: v.one_by_one(pieces[begins[i] : begins[i + 1]].tobytes()))
    to = np.searchsorted(v.known, hashes)
    v.known = np.insert(v.known, to, hashes)
    v.known_at = np.insert(v.known_at, to, place[:-1] + len(v.known_ids))
    v.known_size = np.insert(v.known_size, to, np.diff(place))
    v.known_ids = np.concatenate((v.known_ids, ids.astype(np.int32)))


def decode(v: Vocabulary, ids: np.ndarray) -> bytes:
    return gather(v.bytes, v.begins[ids], v.sizes[ids]).tobytes()


def encode(v: Vocabulary, texts: list[bytes]) -> Iterator[np.ndarray]:
    """The ids of each text, checked to decode to it."""
    if len(v.known) > KNOWN:
        v.forget()
    parts = [texts[s:e] for s, e in blocks([len(t) for t in texts])]
    split = [split_block(v, p) for p in parts]
    learn(v, split) if split else None
    for part, (hashes, of, counts, *_) in zip(parts, split):
        of = np.searchsorted(v.known, hashes)[of]
        sizes = v.known_size[of]
        ids = gather(v.known_ids, v.known_at[of], sizes)
        place = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
        for i, t in enumerate(part):
            own = ids[place[i] : place[i + 1]]
            if decode(v, own) != t:
                own = np.array([x for m in v.pattern.findall(t.decode()) for x in v.one_by_one(m.encode())], np.int64)
            yield own


def encoded(v: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Iterator[np.ndarray]]]:
    """The first column of each batch, and the ids of its texts; batches are encoded in groups."""
    for group in gathered(batches):
        texts = [as_bytes(b.column(1)) for b in group]
        ids = encode(v, [t for x in texts for t in x])
        for b, x in zip(group, texts):
            yield b.column(0), islice(ids, len(x))


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the whole text of each row as an array of ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for docs, found in encoded(v, batches):
            yield pa.RecordBatch.from_arrays([docs, pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode_ids(coded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, bytes: the decoded ids; a null array counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for b in batches:
            out = [decode(v, np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(tidy(run), "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encoding and decoding give, without moving the ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for docs, found in encoded(v, batches):
            n, coded, back = [], [], []
            for ids in found:
                n.append(len(ids))
                coded.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(decode(v, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([docs, pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
