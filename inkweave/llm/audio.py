"""Telephony audio as media columns (operator 5).

``store`` puts bytes losslessly into the 8-bit samples of a WAV file (mu-law or
A-law codes, or IMA ADPCM blocks of 64 bytes); ``decode`` reads WAV files of
these kinds into 16-bit PCM at another rate.  mu-law and A-law are expanded by
lookup tables.  ADPCM blocks carry their own state, so all blocks of many files
are decoded together, one sample position at a time, by tables of (step index,
code).  Resampling is a 4-tap cubic polyphase filter in integers that doesn't
look beyond a file's ends, so equal bytes give equal PCM everywhere.
``store_pcm`` keeps the resampled PCM of all three kinds as a media table.

The query stores the WAV files and reads them back, stores the PCM at 16 kHz of
their payload read as each of the three kinds, and works its features out from
that table as it is read back.

Nulls and edge cases: a null text is empty; an empty text is 64 zero bytes; a
null or malformed media value decodes to null PCM with the reason in ``error``;
a short last ADPCM block is filled with zeros.  Repeated rows get equal values;
other columns are ignored.  Memory follows the slice of rows, or the longest
single file; nothing is shuffled.  A payload of 137 MB or more has more PCM
than one row holds and is an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.common import arrow_map, buffers, pack, stored

UNIT = 64
RATE = 8000
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 0x11}
PART_BYTES = 1 << 20
#: Large pages let zstd find repeats further back; level 12 takes twice the time of 9 for 6 to 7 % less.
DENSE = {"parquet.compression.codec.zstd.level": 9, "parquet.page.size": 16 << 20, "parquet.enable.dictionary": "false"}
#: PCM takes about 15 times the bytes of its payload, and a reader holds a whole row group of it: these are small. A page
#: never fills before its group does, so that a group ends by its raw bytes, looked at every 8 rows, however well they compress.
GROUPS = DENSE | {
    "parquet.page.size": 64 << 20, "parquet.block.size": 32 << 20, "parquet.block.row.count.limit": 512,
    "parquet.page.size.row.check.min": 8, "parquet.page.size.row.check.max": 8,
}


def _mulaw() -> np.ndarray:
    code = ~np.arange(256, dtype=np.uint8)
    size = (((code & 0x0F).astype(np.int32) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    low, power = (code & 0x0F).astype(np.int32) << 4, (code >> 4 & 7).astype(np.int32)
    size = np.where(power > 0, low + 0x108 << np.maximum(power - 1, 0), low + 8)
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _adpcm() -> tuple[np.ndarray, np.ndarray]:
    """Change of the predictor, and 16 times the next step index, by 16 * index + code."""
    step = np.array(_STEPS, np.int32)[:, None]
    code = np.arange(16)
    size = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
    move = np.where(code & 4, ((code & 3) + 1) * 2, -1)
    index = np.clip(np.arange(89)[:, None] + move, 0, 88) * 16
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), index.astype(np.int32).ravel()


# fmt: off
_STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130,
    143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282,
    1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630,
    9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
# fmt: on
MULAW, ALAW = _mulaw(), _alaw()
_CHANGE, _NEXT = _adpcm()


def decode_blocks(data: np.ndarray, block: int = UNIT) -> np.ndarray:
    """IMA ADPCM (mono) blocks of ``block`` bytes: one row of 2 * block - 7 samples each."""
    data = data.reshape(-1, block)
    out = np.empty((2 * block - 7, len(data)), np.int16)
    now = (data[:, 0].astype(np.int32) | data[:, 1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    index = np.minimum(data[:, 2], 88).astype(np.int32) * 16
    out[0] = now
    codes = np.ascontiguousarray(data[:, 4:].T)
    for k in range(block - 4):
        for half, code in enumerate((codes[k] & 15, codes[k] >> 4)):
            cell = index + code
            now = np.clip(now + _CHANGE[cell], -32768, 32767)
            index = _NEXT[cell]
            out[2 * k + half + 1] = now
    return np.ascontiguousarray(out.T)


def resample(x: np.ndarray, off: np.ndarray, up: int, down: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Files ``off[k]:off[k+1]`` of ``x`` at ``up / down`` times the rate, and the new offsets."""
    n = np.diff(off)
    m = -(-n * up // down)
    to = np.concatenate([[0], np.cumsum(m)])
    at = (np.arange(to[-1]) - np.repeat(to[:-1], m)) * down
    base, phase = at // up + np.repeat(off[:-1], m), at % up
    t = np.arange(up) / up
    taps = np.round(4096 * np.stack([(-(t**3) + 2 * t**2 - t) / 2, (3 * t**3 - 5 * t**2 + 2) / 2, (-3 * t**3 + 4 * t**2 + t) / 2, (t**3 - t**2) / 2], 1)).astype(np.int32)
    low, high = np.repeat(off[:-1], m), np.repeat(off[1:] - 1, m)
    wide = np.zeros(len(at), np.int32)
    for k in range(4):
        wide += taps[phase, k] * x[np.clip(base + (k - 1), low, high)].astype(np.int32)
    return np.clip(wide + 2048 >> 12, -32768, 32767).astype(np.int16), to


def double(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """``resample(x, off, 2)`` without index arrays: the same taps at phase one half, -1 9 9 -1 over 16."""
    wide = x.astype(np.int32)
    before, after, later = np.empty_like(wide), np.empty_like(wide), np.empty_like(wide)
    before[1:], after[:-1], later[:-2] = wide[:-1], wide[1:], wide[2:]
    a, b = off[:-1], off[1:] - 1
    before[a], after[b], later[b] = wide[a], wide[b], wide[b]
    later[np.maximum(b - 1, a)] = wide[b]
    out = np.empty((len(x), 2), np.int16)
    out[:, 0] = x
    out[:, 1] = np.clip((wide + after) * 9 - before - later + 8 >> 4, -32768, 32767)
    return out.ravel()


# == WAV


def wav(payload: bytes, codec: str, samples: int, rate: int = RATE) -> bytes:
    """A mono WAV file whose data chunk is ``payload``; its fact chunk holds ``samples``."""
    extra = struct.pack("<HH", 2, 2 * UNIT - 7) if codec == "adpcm" else b"\0\0"
    align, bits = (UNIT, 4) if codec == "adpcm" else (1, 8)
    head = struct.pack("<HHIIHH", TAGS[codec], 1, rate, rate if align == 1 else rate * UNIT // (2 * UNIT - 7), align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<II", 4, samples & 0xFFFFFFFF) + b"data" + struct.pack("<I", len(payload))
    return b"RIFF" + struct.pack("<I", len(body) + len(payload)) + body + payload


def read_wav(data: bytes) -> tuple[str, int, int, int, memoryview]:
    """(codec, rate, bytes in a block, samples, payload); ValueError says what is wrong."""
    view = memoryview(data)
    if len(view) < 12 or view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("no RIFF WAVE header")
    at, form, samples = 12, None, None
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if at + 8 + size > len(view):
            raise ValueError("chunk beyond the end")
        if name == b"fmt " and size >= 16:
            form = struct.unpack_from("<HHIIHH", view, at + 8)
        elif name == b"fact" and size >= 4:
            samples = struct.unpack_from("<I", view, at + 8)[0]
        elif name == b"data":
            codec = next((k for k, v in TAGS.items() if form and form[0] == v), None)
            if codec is None or form[1] != 1 or not form[2] or (codec == "adpcm" and form[4] < 5):
                raise ValueError("not a mono telephony format")
            return codec, form[2], form[4], size if samples is None else samples, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


# == operators


def store(docs: DataFrame, codec: str = "mulaw", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, media``: the UTF-8 bytes, filled with zeros to a positive multiple of 64, in a WAV file."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = buffers(batch.column("text"))
        view, ends = memoryview(data), off.tolist()
        media = [wav(bytes(view[a:b]) + bytes(-(b - a) % UNIT if b > a else UNIT), codec, b - a) for a, b in zip(ends, ends[1:])]
        return pa.record_batch([batch.column("doc_id"), pack(media)], names=["doc_id", "media"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), kernel, "doc_id long, media binary")


def _pcm(codec: str, block: int, payload: memoryview) -> np.ndarray:
    x = np.frombuffer(payload, np.uint8)
    if codec != "adpcm":
        return (MULAW if codec == "mulaw" else ALAW)[x]
    return decode_blocks(np.concatenate([x, np.zeros(-len(x) % block, np.uint8)]), block).ravel()


def decode(media: DataFrame, rate: int = 16000, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``doc_id, codec, rate, n_samples, pcm, error``: 16-bit little-endian PCM at ``rate``."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data in batch.column("media").to_pylist():
            try:
                codec, own, block, _, payload = read_wav(data if data is not None else b"")
            except ValueError as e:
                rows.append((None, None, None, None, "null" if data is None else str(e)))
                continue
            x = _pcm(codec, block, payload)
            g = np.gcd(rate, own)
            x = resample(x, np.array([0, len(x)]), rate // g, own // g)[0] if rate != own and len(x) else x
            rows.append((codec, rate, len(x), x.astype("<i2").tobytes(), None))
        cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string()))]
        return pa.record_batch([batch.column("doc_id"), *cols], names=["doc_id", "codec", "rate", "n_samples", "pcm", "error"])

    picked = media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"))
    return arrow_map(picked, kernel, "doc_id long, codec string, rate int, n_samples long, pcm binary, error string", text="media")


def store_pcm(media: DataFrame, rate: int = 16000, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``decode``'s rows as a media table in the shared folder, read back: what a trainer of models would read."""
    return stored(decode(media, rate, id_col, media_col), "pcm")


def _measures(x: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Energy, sign changes and peak of each file (none is empty)."""
    wide = x.astype(np.int32)
    turn = np.zeros(len(x), np.int64)
    turn[1:] = (wide[1:] < 0) != (wide[:-1] < 0)
    turn[off[:-1]] = 0
    return [np.add.reduceat((wide * wide).astype(np.int64), off[:-1]), np.add.reduceat(turn, off[:-1]), np.maximum.reduceat(np.abs(wide), off[:-1])]


TOLD = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
PCM = {"pcm_mulaw": "mulaw", "pcm_alaw": "alaw", "pcm_adpcm": "adpcm"}


def _pcm_column(x: np.ndarray, off: np.ndarray) -> pa.Array:
    return pack(double(x, off).astype("<i2", copy=False).view(np.uint8), 4 * off)


def readings(media: DataFrame) -> DataFrame:
    """Digests of stored files, and their payload read as mu-law, A-law and ADPCM (64-byte blocks): 16-bit little-endian PCM at 16 kHz."""
    schema = TOLD + "".join(f", {c} binary" for c in PCM)

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        media = part.column("media").to_pylist()
        read = [read_wav(m) for m in media]
        payload = [r[4] for r in read]
        size = np.fromiter(map(len, payload), np.int64, len(payload))
        if len(size) and size.max() >= 137_000_000:
            raise ValueError(f"the PCM of a payload of {size.max()} bytes is more than a row holds")
        off = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join(payload), np.uint8)
        columns = [
            part.column("doc_id"), pa.array([r[3] for r in read], pa.int64()), pa.array(size), pa.array([hashlib.sha256(p).hexdigest() for p in payload]),
            pa.array([zlib.crc32(p[-UNIT:]) for p in payload], pa.int64()), pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]),
            _pcm_column(MULAW[data], off), _pcm_column(ALAW[data], off), _pcm_column(decode_blocks(data).ravel(), off // UNIT * (2 * UNIT - 7)),
        ]
        return pa.record_batch(columns, names=[f.split()[0] for f in schema.split(", ")])

    return arrow_map(media.select("doc_id", "media"), kernel, schema, text="media", limit=PART_BYTES)


def features(kept: DataFrame) -> DataFrame:
    """``readings`` with a feature in place of the PCM: energy, sign changes and peak of each reading at 8 kHz, and a checksum of the mu-law PCM."""
    names = [f.split()[0] for f in TOLD.split(", ")]

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        told, sums = [], []
        for c, name in PCM.items():
            data, off = buffers(part.column(c))
            data, off = data[off[0] : off[-1]], off - off[0]
            told.append([f"{name}:{e},{t},{p}" for e, t, p in zip(*(m.tolist() for m in _measures(data.view("<i2")[::2], off // 4)))])  # every other sample is one of the file's own
            if name == "mulaw":
                view, ends = memoryview(data), off.tolist()
                sums = [f"pcm16k:{zlib.crc32(view[a:b]):08x}" for a, b in zip(ends, ends[1:])]
        return pa.record_batch([*map(part.column, names), pa.array(list(map(";".join, zip(*told, sums))), pa.string())], names=[*names, "feature"])

    return arrow_map(kept.select(*names, *PCM), kernel, TOLD + ", feature string", text="pcm_mulaw", limit=4 * PART_BYTES)


def round_trip(docs: DataFrame, codec: str = "mulaw") -> DataFrame:
    """Stores all texts as a table of WAV files, reads it back, stores the PCM of its ``readings``, reads that back and computes ``features``."""
    media = stored(store(docs, codec), "media", DENSE)
    return features(stored(readings(media), "pcm", GROUPS))
