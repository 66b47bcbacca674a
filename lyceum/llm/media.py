"""Telephony audio columns (operator 1).

A media value is a WAV file whose samples are 8-bit G.711 codes, so any byte string
is stored without loss. ``store`` wraps bytes, ``read_back`` parses them again, and the
lookup tables expand mu-law or A-law codes; IMA ADPCM blocks are decoded with numpy, one step for
all blocks at once; ``doubled`` resamples to twice the rate.

``telephony`` takes two steps: ``encoded`` media are written as a table in the shared folder, and ``decoded``
reads that table back and makes the resampled PCM and the features from what it holds.

Nulls and empty texts give one block of padding; text length is not limited, and
batches are cut so that a group of documents decodes at once in bounded memory.
Repeated rows give repeated results, an empty table an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, raw, shared_folder, without

BLOCK = 576
RATE = 8000
#: WAV format tags (fixed values of the container format).
MULAW, ALAW, IMA_ADPCM = 7, 6, 17
#: Bytes of one ADPCM block: a 4-byte header and two samples a byte; divides BLOCK.
ADPCM_BLOCK = 64
#: Payload bytes whose blocks are decoded together.
GROUP_BYTES = 1 << 21

#: Index adjustments of IMA ADPCM, by the low three bits of a code (fixed values).
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
#: Step sizes of IMA ADPCM (fixed values).
STEP_SIZE = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66,
        73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408,
        449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
        2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630,
        9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    dtype=np.int32,
)


def mulaw_table() -> np.ndarray:
    """PCM16 value of each mu-law code."""
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    magnitude = ((((u & 0x0F) << 3) + 0x84) << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM16 value of each A-law code."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    segment, low = (a >> 4) & 7, (a & 0x0F) << 4
    magnitude = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(a & 0x80, magnitude, -magnitude).astype(np.int16)


def adpcm_step_table() -> np.ndarray:
    """Difference that each (step index, code) adds to the prediction."""
    code, step = np.arange(16)[None, :], STEP_SIZE[:, None]
    diff = (step >> 3) + (code & 1) * (step >> 2) + ((code >> 1) & 1) * (step >> 1) + ((code >> 2) & 1) * step
    return np.where(code & 8, -diff, diff).astype(np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM16 samples of IMA ADPCM ``blocks`` (uint8, one block a row).

    The loop runs over the samples of a block; each turn handles all blocks. An index
    beyond the table, which only a damaged header holds, is clamped.
    """
    n, width = blocks.shape
    add = adpcm_step_table().ravel()
    move = np.concatenate([INDEX_STEP, INDEX_STEP])
    predicted = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    codes = np.empty((2 * body.shape[0], n), dtype=np.int32)
    codes[0::2], codes[1::2] = body & 0x0F, body >> 4
    out = np.empty((1 + len(codes), n), dtype=np.int16)
    out[0] = predicted
    for i, code in enumerate(codes, 1):
        predicted += add[(index << 4) + code]
        np.clip(predicted, -32768, 32767, out=predicted)
        index += move[code]
        np.clip(index, 0, 88, out=index)
        out[i] = predicted
    return np.ascontiguousarray(out.T)


def doubled(pcm: np.ndarray) -> np.ndarray:
    """``pcm`` at twice the rate: a half-band filter of four taps between the samples."""
    x = pcm.astype(np.int32)
    p = np.concatenate([x[:1], x, x[-1:], x[-1:]])
    between = (9 * (p[1:-2] + p[2:-1]) - p[:-3] - p[3:] + 8) >> 4
    out = np.empty(2 * len(x), dtype=np.int16)
    out[0::2], out[1::2] = x, np.clip(between, -32768, 32767)
    return out


def store(payload: bytes, codec: int = MULAW, rate: int = RATE) -> bytes:
    """A WAV file of 8-bit samples that holds ``payload`` as it is (padded to even length)."""
    bits, align = (4, ADPCM_BLOCK) if codec == IMA_ADPCM else (8, 1)
    extra = struct.pack("<HH", 2, 2 * (ADPCM_BLOCK - 4) + 1) if codec == IMA_ADPCM else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", codec, 1, rate, rate * bits // 8, align, bits) + extra
    pad = b"\0" * (len(payload) & 1)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_back(media: bytes) -> tuple[int, int, bytes]:
    """Codec, rate and sample bytes of a stored WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate = 12, 0, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            codec, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif kind == b"data":
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("a WAV file without samples")


def padded(data: bytes) -> bytes:
    """``data`` and bytes 255 up to a positive multiple of BLOCK."""
    return data + b"\xff" * ((-len(data)) % BLOCK if data else BLOCK)


FIELDS = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("media", T.BinaryType()),
    T.StructField("pcm", T.BinaryType()),
]


def decode_group(payloads: list[bytes], table: np.ndarray, other: np.ndarray) -> list[tuple[str, bytes]]:
    """Feature and resampled mu-law PCM of each payload; ADPCM blocks of all decode at once."""
    joined = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    linear = table[joined]
    squares = {
        "u": linear.astype(np.float64) ** 2,
        "a": other[joined].astype(np.float64) ** 2,
        "i": (decode_adpcm(joined.reshape(-1, ADPCM_BLOCK)).astype(np.float64) ** 2).mean(axis=1),
    }
    ends = np.cumsum([len(p) for p in payloads])
    starts = ends - [len(p) for p in payloads]
    rms = {
        k: np.sqrt(np.add.reduceat(v, starts // (ADPCM_BLOCK if k == "i" else 1)) / ((ends - starts) // (ADPCM_BLOCK if k == "i" else 1)))
        for k, v in squares.items()
    }
    sign = linear < 0
    out = []
    for j, (a, b) in enumerate(zip(starts, ends, strict=True)):
        pcm = doubled(linear[a:b])
        crossings = int(np.count_nonzero(sign[a + 1 : b] != sign[a : b - 1]))
        feature = f"mulaw_rms={rms['u'][j]:.3f};alaw_rms={rms['a'][j]:.3f};adpcm_rms={rms['i'][j]:.3f};crossings={crossings};pcm16k_crc32={zlib.crc32(pcm.tobytes()):08x}"
        out.append((feature, pcm.tobytes()))
    return out


def encoded(df: DataFrame, text_col: str = "text", codec: int = MULAW) -> DataFrame:
    """``df`` with ``media``: its padded texts as stored media."""

    def start():
        return lambda column: [pa.array([store(padded(data), codec) for data in raw(column)], pa.binary())]

    return add_columns(df, [text_col], [FIELDS[-2]], start)


def unpadded(payload: bytes) -> int:
    """Bytes of the text in a payload: UTF-8 has no byte 255, so these are the padding."""
    return len(payload.rstrip(b"\xff"))


def decoded(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` with FIELDS, all read from its media column of mu-law files; ``pcm`` is 16-bit little-endian at twice the stored rate.

    Columns of those names are replaced. Rows go out in groups of about GROUP_BYTES of payload, whatever the size of the batch.
    """
    keep = without(df, [f.name for f in FIELDS])
    schema = T.StructType([*(df.schema[c] for c in keep), *FIELDS])
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mu, a = mulaw_table(), alaw_table()

        def made(b: pa.RecordBatch, first: int, files: list[bytes], payloads: list[bytes]) -> pa.RecordBatch:
            rows = []
            for media, payload, (feature, pcm) in zip(files, payloads, decode_group(payloads, mu, a), strict=True):
                rows.append((unpadded(payload), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, media, pcm))
            own = b.slice(first, len(files)).columns[:n_keep]
            return pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=schema.names)

        for b in batches:
            first, size, files, payloads = 0, 0, [], []
            for i, media in enumerate(raw(b.column(n_keep)), 1):
                codec, _, payload = read_back(media)
                if codec != MULAW:
                    raise ValueError(f"unexpected codec {codec}")
                files.append(media)
                payloads.append(payload)
                size += len(payload)
                if size >= GROUP_BYTES or i == b.num_rows:
                    yield made(b, first, files, payloads)
                    first, size, files, payloads = i, 0, [], []

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{media_col}`").alias("_media")).mapInArrow(run, schema)


def telephony(df: DataFrame, text_col: str = "text", keep_media: bool = True, path: str | None = None) -> DataFrame:
    """``df`` with the stored media of its texts, the resampled PCM and what is read back.

    The media are written once to ``path`` (by default a folder of their own in the shared folder, which stays until
    the caller removes it) and read from there. New columns: FIELDS; ``media`` only with ``keep_media``. Columns of those names are replaced.
    """
    path = path or f"{shared_folder(df.sparkSession)}/telephony-{uuid.uuid4().hex}"
    encoded(df, text_col).write.option("compression", "zstd").parquet(path)
    out = decoded(df.sparkSession.read.parquet(path))
    return out if keep_media else out.drop("media")
