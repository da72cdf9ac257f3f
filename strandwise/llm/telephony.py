"""Telephony audio columns: 8-bit companded samples and ADPCM blocks in RIFF files.

Mu-law and A-law expand through 256-entry tables built from their rules. IMA
ADPCM decodes with one numpy step for each sample of a block, over all blocks
of a run at once. Decoded 8 kHz audio is stored as 16 kHz 16-bit PCM, each new
sample the mean of its neighbours.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import runs

RATE = 8000
MULAW, ALAW, ADPCM = 7, 6, 17
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "ima_adpcm"}
#: Bytes of an ADPCM block: 4 of header, which hold the first sample, and two samples in each other.
BLOCK = 36
BLOCKS_AT_ONCE = 1 << 14

# Fixed values of the IMA ADPCM format.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 255
    size = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 85
    part, low = a >> 4 & 7, (a & 15) << 4
    size = np.where(part == 0, low + 8, low + 264 << np.maximum(part - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}
#: What one nibble adds at one step index.
_DELTA = np.array([[(-1 if n & 8 else 1) * sum(int(s) >> k for k, bit in ((3, 15), (0, 4), (1, 2), (2, 1)) if n & bit or k == 3) for n in range(16)] for s in STEPS], np.int32).ravel()
_MOVE = np.tile(MOVES, 2)


def decode_adpcm(data: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """16-bit samples of whole blocks (uint8), 2 * (block - 4) + 1 for each."""
    blocks = data.reshape(-1, block)
    out = np.empty((len(blocks), 2 * (block - 4) + 1), np.int16)
    for at in range(0, len(blocks), BLOCKS_AT_ONCE):
        part = np.ascontiguousarray(blocks[at : at + BLOCKS_AT_ONCE].T)
        value = (part[0].astype(np.int32) | part[1].astype(np.int32) << 8) << 16 >> 16
        index = np.minimum(part[2].astype(np.int32), len(STEPS) - 1)
        got = np.empty((out.shape[1], part.shape[1]), np.int16)
        got[0] = value
        for k in range(2 * (block - 4)):
            nibble = (part[4 + k // 2] >> (4 * (k % 2)) & 15).astype(np.int32)
            value = np.clip(value + _DELTA[index * 16 + nibble], -32768, 32767)
            index = np.clip(index + _MOVE[nibble], 0, len(STEPS) - 1)
            got[k + 1] = value
        out[at : at + BLOCKS_AT_ONCE] = got.T
    return out.ravel()


def riff(payload: bytes, codec: int, rate: int = RATE) -> bytes:
    """A WAVE file with the payload as its data chunk, byte for byte."""
    if codec == ADPCM:
        per = 2 * (BLOCK - 4) + 1
        fmt = struct.pack("<HHIIHHHH", codec, 1, rate, rate * BLOCK // per, BLOCK, 4, 2, per)
    else:
        fmt = struct.pack("<HHIIHHH", codec, 1, rate, rate, 1, 8, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unriff(media: bytes) -> tuple[int, int, bytes]:
    """(codec, block size, payload) of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, block = 12, 0, 1
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            codec, block = struct.unpack_from("<H", media, at + 8)[0], struct.unpack_from("<H", media, at + 20)[0]
        if name == b"data":
            return codec, block, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate, by means of neighbours; the last sample is held."""
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    if len(pcm):
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        out[-1] = pcm[-1]
    return out


def padded(text: bytes | None, unit: int = 576) -> bytes:
    t = text or b""
    return t + b"\xff" * (max(unit, -(-len(t) // unit) * unit) - len(t))


def _store(batches):
    for b in batches:
        raw, media = b.column(1).to_pylist(), []
        for t in raw:
            p = padded(t)
            media.append(riff(p, (MULAW, ALAW, ADPCM)[zlib.crc32(p) % 3]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or b"") for t in raw], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])


def features(pcm: np.ndarray) -> str:
    """Length, level, crossings of zero and peak of 16-bit PCM."""
    x = pcm.astype(np.int64)
    cross = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))) if len(x) else 0
    rms = (int((x * x).sum()) / max(1, len(x))) ** 0.5
    return f"n={len(x)};rms={rms:.3f};cross={cross};peak={int(np.abs(x).max(initial=0))};crc={zlib.crc32(pcm.astype('<i2').tobytes())}"


def decode_all(files: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """16-bit samples of each (codec, block size, payload); ADPCM blocks of all
    files with one block size are decoded together."""
    out: list = [None if codec == ADPCM else TABLES[codec][np.frombuffer(payload, np.uint8)] for codec, _, payload in files]
    for block in {b for codec, b, _ in files if codec == ADPCM}:
        own = [i for i, f in enumerate(files) if f[:2] == (ADPCM, block)]
        ends = np.cumsum([len(files[i][2]) // block * (2 * (block - 4) + 1) for i in own])
        pcm = decode_adpcm(np.frombuffer(b"".join(files[i][2] for i in own), np.uint8), block)
        for i, part in zip(own, np.split(pcm, ends[:-1])):
            out[i] = part
    return out


def _load(batches, with_pcm: bool):
    for whole in batches:
        for lo, hi in runs(whole.column(2).to_pylist()):
            yield _loaded(whole.slice(lo, hi - lo), with_pcm)


def _loaded(b, with_pcm: bool):
    cols: list[list] = [[], [], [], [], [], [], []]
    media = b.column(2).to_pylist()
    files = [unriff(m) for m in media]
    for m, (codec, _, payload), raw in zip(media, files, decode_all(files)):
        pcm = resample(raw)
        row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), f"{NAMES[codec]};rate={2 * RATE};{features(pcm)}", pcm.astype("<i2").tobytes() if with_pcm else None)
        for c, v in zip(cols, row):
            c.append(v)
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"]
    arrays = [b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))]
    keep = len(names) if with_pcm else -1
    return pa.RecordBatch.from_arrays(arrays[:keep], names[:keep])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: each text's UTF-8 bytes, filled with bytes 255 to a
    positive multiple of 576, as the samples of a WAVE file. The payload's crc32
    picks among mu-law, A-law and ADPCM, so equal texts have equal media. Null
    texts count as empty; other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(_store, "id long, n_bytes long, media binary")


def load_media(stored: DataFrame, id_col: str = "doc_id", with_pcm: bool = False) -> DataFrame:
    """Reads ``store_texts``' column back: payload digests, features of the
    16 kHz PCM and, on request, that PCM itself as 16-bit little-endian bytes."""
    schema = f"{id_col} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.mapInArrow(lambda it: _load(it, with_pcm), schema + ", pcm binary" * with_pcm)
