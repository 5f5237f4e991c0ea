"""Telephony audio columns: mu-law, A-law and ADPCM to resampled 16-bit PCM.

Companded bytes expand by 256-entry tables built from the G.711 rules.  ADPCM
(IMA, one channel) has a serial recurrence inside a block but none between
blocks, so step ``t`` of all blocks of a batch is one numpy operation.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .kernels import buffer
from .tables import read

#: Format tags of RIFF/WAVE.
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "adpcm": 0x11}
RATE = 8000
#: Samples decoded at once.
BATCH = 1 << 20
#: The step sizes and index changes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    value = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -value, value).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, value = code >> 4 & 7, (code & 15) << 4
    value = np.where(part == 0, value + 8, (value + 264) << np.maximum(part - 1, 0))
    return np.where(code & 128, value, -value).astype(np.int16)


TABLES = {"mulaw": _mulaw(), "alaw": _alaw()}


def expand(codes: np.ndarray, law: str) -> np.ndarray:
    """16-bit samples of companded bytes."""
    return TABLES[law][codes]


def compress(samples: np.ndarray, law: str) -> np.ndarray:
    """The nearest companded byte of each sample (the lower value on ties)."""
    table = TABLES[law].astype(np.int32)
    order = np.argsort(table, kind="stable")
    levels = table[order]
    return order[np.searchsorted((levels[1:] + levels[:-1]) / 2, samples, "left")].astype(np.uint8)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks, one row of ``1 + 2 * (width - 4)`` for each.

    A block is a 16-bit first sample, a step index (clipped to the table), a
    reserved byte and two codes in each further byte, low one first.
    """
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    out[0] = value
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for t in range(2 * (width - 4)):
        code = columns[t >> 1] >> 4 if t & 1 else columns[t >> 1] & 15
        code = code.astype(np.int32)
        step = STEPS[index]
        change = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + CHANGES[code & 7], 0, len(STEPS) - 1)
        out[t + 1] = value
    return out.T


def encode_adpcm(samples: np.ndarray, width: int = 256) -> np.ndarray:
    """Blocks whose decoding follows ``samples``; the last one is padded with its last sample."""
    per = 1 + 2 * (width - 4)
    n = max(1, -(-len(samples) // per))
    pcm = np.pad(samples.astype(np.int32), (0, n * per - len(samples)), "edge" if len(samples) else "constant").reshape(n, per).T
    out = np.zeros((n, width), np.uint8)
    value, index = pcm[0].copy(), np.zeros(n, np.int32)
    out[:, 0], out[:, 1] = value & 255, value >> 8 & 255
    for t in range(per - 1):
        step, gap = STEPS[index], pcm[t + 1] - value
        code = np.where(gap < 0, 8, 0) | np.minimum(7, (np.abs(gap) * 4) // step)
        change = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + CHANGES[code & 7], 0, len(STEPS) - 1)
        out[:, 4 + (t >> 1)] |= (code << 4 * (t & 1)).astype(np.uint8)
    return out


def resample(samples: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation, rounded to even; the last sample is held.  No samples give none.

    On the way down, each sample is first the mean of those around it, as many
    as one of the target spans, so that what is too high for it goes.
    """
    if source == target or not len(samples):
        return samples
    n = -(-len(samples) * target // source)
    wide = samples.astype(np.int32)
    if target == 2 * source:
        out = np.empty(n, np.int16)
        out[::2] = samples
        both = wide[:-1] + wide[1:]
        out[1:-1:2] = (both >> 1) + (both & (both >> 1) & 1)
        out[-1] = samples[-1]
        return out
    width = -(-source // target) | 1
    if target < source:
        run = np.r_[0.0, np.cumsum(np.pad(wide, width // 2, "edge").astype(float))]
        wide = (run[width:] - run[:-width]) / width
    return np.rint(np.interp(np.arange(n) * source / target, np.arange(len(samples)), wide)).astype(np.int16)


def wave(data: bytes, codec: str, rate: int = RATE, width: int = 256) -> bytes:
    """A RIFF/WAVE file of one channel around coded ``data``."""
    bits, align, per, extra = {"pcm": (16, 2, rate * 2, b""), "adpcm": (4, width, rate * width // (2 * width - 7), struct.pack("<HH", 2, 2 * width - 7))}.get(codec, (8, 1, rate, struct.pack("<H", 0)))
    head = struct.pack("<HHIIHH", TAGS[codec], 1, rate, per, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(file: bytes) -> tuple[str, int, int, memoryview]:
    """Codec, rate, block width and coded data of a file made by :func:`wave` or alike; ValueError if it is none."""
    view, at, form = memoryview(file), 12, None
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    while at + 8 <= len(view):
        kind, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if kind == b"fmt ":
            form = struct.unpack_from("<HHIIHH", view, at + 8)
        elif kind == b"data":
            if form is None or form[1] != 1 or form[0] not in TAGS.values():
                raise ValueError("only one channel of a known coding is read")
            return next(k for k, v in TAGS.items() if v == form[0]), form[2], form[4], view[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data")


def decode(file: bytes) -> tuple[np.ndarray, int]:
    """Samples and rate of a file."""
    codec, rate, width, data = parse(file)
    raw = np.frombuffer(data, np.uint8)
    if codec == "pcm":
        return raw[: len(raw) & ~1].view("<i2").astype(np.int16), rate
    if codec == "adpcm":
        return decode_adpcm(raw[: len(raw) // width * width].reshape(-1, width)).reshape(-1), rate
    return expand(raw, codec), rate


def payload(data: bytes, unit: int = 64) -> bytes:
    """``data`` and zero bytes up to a positive multiple of ``unit``."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def features(samples: np.ndarray) -> str:
    """Length, root mean square, sign changes per 1000 samples and peak of PCM."""
    if not len(samples):
        return "n=0"
    wide = samples.astype(np.float32)
    rms = float(np.sqrt(np.dot(wide, wide) / len(wide)))
    turns = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    return f"n={len(samples)};rms={rms:.1f};zcr={1000 * turns / len(samples):.2f};peak={max(int(samples.max()), -int(samples.min()))}"


def telephony(df: DataFrame, column: str, keep: list[str], codec: str = "mulaw", target: int = 2 * RATE) -> DataFrame:
    """Store a text or binary column as telephony audio and as resampled PCM.

    Each value's bytes (null: none), padded to whole blocks of 64, become the
    data of a WAVE file (``media``); they are read back from it, expanded by the
    codec's table (``mulaw`` or ``alaw``) and resampled to ``pcm``, a WAVE file
    at ``target`` Hz.  Columns: ``keep``, then n_bytes, payload (as read back),
    media, pcm, feature (of the PCM as read back), other (of the payload under
    the other law) and blocks (of the payload as ADPCM blocks of 64 bytes).
    Every row gives one, repeats and null keys too; an empty table gives none.
    ``keep`` and ``column`` must name one column each and ``keep`` none of the
    new ones: ValueError.  Files of more than 2 GiB would not fit a cell.
    """
    made = ("n_bytes", "payload", "media", "pcm", "feature", "other", "blocks")
    if set(keep) & set(made) or any(df.columns.count(c) != 1 for c in (*keep, column)):
        raise ValueError(f"names clash: {keep}")
    if codec not in TABLES:
        raise ValueError(f"not a companding law: {codec}")
    fields, law = [df.schema[c] for c in keep], "alaw" if codec == "mulaw" else "mulaw"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffer(batch.column(len(keep)))
            i = 0
            while i < len(offs) - 1:
                j = max(i + 1, int(np.searchsorted(offs, offs[i] + BATCH, "right")) - 1)
                media, back, sound, feature, other, sizes = [], [], [], [], [], []
                for r in range(i, j):
                    sizes.append(int(offs[r + 1] - offs[r]))
                    media.append(wave(payload(data[offs[r] : offs[r + 1]].tobytes()), codec))
                    kind, rate, _, stored = parse(media[-1])
                    back.append(bytes(stored))
                    codes = np.frombuffer(stored, np.uint8)
                    sound.append(wave(resample(expand(codes, kind), rate, target).tobytes(), "pcm", target))
                    feature.append(features(decode(sound[-1])[0]))
                    other.append(features(expand(codes, law)))
                ends = np.cumsum([len(x) // 64 for x in back])
                decoded = decode_adpcm(np.frombuffer(b"".join(back), np.uint8).reshape(-1, 64))
                rows = np.split(decoded, ends[:-1])
                yield pa.record_batch(
                    [batch.column(c).slice(i, j - i) for c in range(len(keep))]
                    + [pa.array(sizes, pa.int64()), pa.array(back, pa.binary()), pa.array(media, pa.binary()), pa.array(sound, pa.binary()), pa.array(feature), pa.array(other), pa.array([features(x.reshape(-1)) for x in rows], pa.string())],
                    names=[*keep, *made],
                )
                i = j

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return df.select(*keep, column).mapInArrow(run, f"{schema}, n_bytes long, payload binary, media binary, pcm binary, feature string, other string, blocks string")


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a mu-law file and as resampled PCM, and digests of what is read back."""
    made = telephony(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"])

    def run(batches):
        for b in batches:
            back, media, pcm = (b.column(c).to_pylist() for c in ("payload", "media", "pcm"))
            sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
            long = lambda xs: pa.array(list(xs), pa.int64())
            feature = [";".join(x) for x in zip(*(b.column(c).to_pylist() for c in ("feature", "other", "blocks")))]
            yield pa.record_batch(
                [b.column("doc_id"), b.column("n_bytes"), long(map(len, back)), sha(back), long(zlib.crc32(x[-64:]) for x in back), long(map(len, media)), sha(media), pa.array(feature, pa.string()), long(map(len, pcm)), sha(pcm)],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256"],
            )

    return made.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string")
