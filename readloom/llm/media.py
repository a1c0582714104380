"""Media columns: telephony audio.

Payload bytes are stored as 8-bit mu-law samples in a WAVE container, which is lossless; features come from the
bytes read back. Mu-law and A-law expand by 256-entry tables; IMA ADPCM blocks of 64 bytes (a 4-byte head and 120 codes)
are decoded step by step with numpy across all blocks at once. Beside the payload, the expanded samples are stored as PCM
resampled from 8 to 4 kHz by a three-tap low-pass filter, edges repeated, in 8 bits. `pcm16k` makes 16-bit PCM at 16 kHz by a
four-tap half-band filter.

A null text counts as empty; an empty text's payload is 64 zero bytes. Equal texts give equal values; repeated rows give
repeated rows; a null id is kept; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import as_bytes, blocks, cut, tidy

RATE, UNIT, MULAW_TAG, PCM_TAG = 8000, 64, 7, 1
# Fixed values of the IMA ADPCM format: step sizes, and how a code moves the step.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exp, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(exp == 0, low + 8, (low + 264) << np.maximum(exp - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()


def adpcm(data: np.ndarray, block: int = UNIT) -> np.ndarray:
    """(blocks, 1 + 2 * (block - 4)) samples of IMA ADPCM mono blocks; all blocks take each step together."""
    rows = data.reshape(-1, block)
    value = rows[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(rows[:, 2], 88).astype(np.int32)
    out = np.empty((1 + 2 * (block - 4), len(rows)), np.int16)
    out[0] = value
    cols = np.ascontiguousarray(rows[:, 4:].T)
    for k in range(block - 4):
        for half, code in enumerate((cols[k] & 15, cols[k] >> 4)):
            step = STEPS[index]
            diff = step >> 3
            diff += np.where(code & 4, step, 0)
            diff += np.where(code & 2, step >> 1, 0)
            diff += np.where(code & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - diff, value + diff), -32768, 32767)
            index = np.clip(index + MOVES[code & 7], 0, 88)
            out[1 + 2 * k + half] = value
    return out.T


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: every sample, and between two the half-band mean (-1, 9, 9, -1) / 16 of its neighbours."""
    if not len(pcm):
        return pcm
    wide = np.concatenate((pcm[:1], pcm, pcm[-1:], pcm[-1:])).astype(np.int32)
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    out[1::2] = np.clip((9 * (wide[1:-2] + wide[2:-1]) - wide[:-3] - wide[3:] + 8) >> 4, -32768, 32767)
    return out


def resample_half(pcm: np.ndarray) -> np.ndarray:
    """Half the rate: every other sample of the mean (1, 2, 1) / 4 over neighbours."""
    if not len(pcm):
        return pcm
    wide = np.concatenate((pcm[:1], pcm, pcm[-1:])).astype(np.int32)
    return ((wide[:-2] + 2 * wide[1:-1] + wide[2:] + 2) >> 2)[::2].astype(np.int16)


def eight_bit(pcm: np.ndarray) -> bytes:
    """The high bytes of 16-bit samples, as 8-bit PCM has them."""
    return ((pcm >> 8) + 128).astype(np.uint8).tobytes()


def wave(data: bytes, tag: int = MULAW_TAG, rate: int = RATE, bits: int = 8) -> bytes:
    """A mono WAVE file."""
    head = struct.pack("<4sIHHIIHHH", b"fmt ", 18, tag, 1, rate, rate * bits // 8, bits // 8, bits, 0)
    body = b"WAVE" + head + struct.pack("<4sI", b"fact", 4) + struct.pack("<I", len(data) * 8 // bits) + struct.pack("<4sI", b"data", len(data)) + data
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def wave_data(media: bytes) -> bytes:
    """The samples of a WAVE file, found by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at = 12
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("a WAVE file without data")


def payload(text: bytes) -> bytes:
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the payload as a mu-law WAVE file; pcm: its samples resampled to 4 kHz, as a WAVE file of 8-bit PCM."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(1))
            data = [payload(t) for t in texts]
            pcm = [wave(eight_bit(resample_half(MULAW[np.frombuffer(x, np.uint8)])), PCM_TAG, RATE // 2) for x in data]
            cols = [pa.array([len(t) for t in texts], pa.int64()), pa.array([wave(x) for x in data], pa.binary()), pa.array(pcm, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_bytes", "media", "pcm"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary, pcm binary")


def pcm16k(stored: DataFrame, media_col: str = "media", out_col: str = "pcm16k") -> DataFrame:
    """stored with the media expanded, resampled to 16 kHz and stored as a 16-bit PCM WAVE file."""
    at = stored.columns.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [None if m is None else wave(resample_double(MULAW[np.frombuffer(wave_data(m), np.uint8)]).astype("<i2").tobytes(), PCM_TAG, 2 * RATE, 16) for m in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], [*b.schema.names, out_col])

    from pyspark.sql.types import StructType

    return stored.mapInArrow(tidy(run), StructType([*stored.schema.fields]).add(out_col, "binary"))


def describe(data: list[bytes], pcm: list[bytes]) -> list[str]:
    """The feature of each payload and its stored PCM: mean energy under both laws, and checksums of the ADPCM samples and the PCM."""
    out: list[str] = []
    for s, e in blocks([len(x) for x in data]):
        joined = np.frombuffer(b"".join(data[s:e]), np.uint8)
        ends = np.cumsum([len(x) for x in data[s:e]])
        mu, law = MULAW[joined], ALAW[joined]
        cuts = np.concatenate(([0], ends[:-1]))
        power = [np.add.reduceat(x.astype(np.int64) ** 2, cuts) for x in (mu, law)]
        steps = adpcm(joined)
        for i, (a, z) in enumerate(zip(cuts.tolist(), ends.tolist())):
            out.append(f"mulaw={int(power[0][i]) // (z - a)};alaw={int(power[1][i]) // (z - a)};adpcm={zlib.crc32(steps[a // UNIT : z // UNIT].astype('<i2').tobytes()):08x};pcm4k={zlib.crc32(pcm[s + i]):08x}")
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        media = b.column(2).to_pylist()
        data = [wave_data(m) for m in media]
        sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
        long = lambda xs: pa.array(xs, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), long([len(x) for x in data]), sha(data), long([zlib.crc32(x[-UNIT:]) for x in data]), long([len(m) for m in media]), sha(media), pa.array(describe(data, [wave_data(m) for m in b.column(3).to_pylist()]), pa.string())],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def features(stored: DataFrame) -> DataFrame:
    return stored.mapInArrow(tidy(_features), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(cut(store(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media"))
