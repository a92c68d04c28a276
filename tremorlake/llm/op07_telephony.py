"""Telephony audio columns: mu-law, A-law and block ADPCM decoding with numpy, resampling, lossless storage of clips and resampled PCM.

A clip is a WAV container of 8-bit mu-law samples at 8 kHz around the bytes as they are, so nothing is lost. Companded
samples expand through lookup tables of 256 entries. ADPCM comes in blocks of 64 bytes (predictor, step index, then
120 four-bit steps); step k of all blocks is decoded at once. ``resample_double`` makes 16 kHz PCM by a short
half-band filter. The query stores it beside the clip and reads it back (``with_pcm``, ``pcm_samples``): 16-bit samples of
the clip's own rate, then what each sample in between differs by from the filter's value, so that any 16 kHz PCM
comes back as it was. ``store_pcm`` keeps decoded clips as plain 16-bit columns.

Null and empty texts give one block of zeros. A clip longer than a worker's block is handled alone. Equal bytes give
equal values; repeated rows are kept. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_docs, written

BLOCK = 64
RATE = 8000
#: Clips in a decoded block of work, in bytes; decoding needs about 40 times as much.
WORK_BYTES = 1 << 19
#: PCM is four times the text as plain samples; on the check table clips and PCM take a tenth less than at Spark's own level, 3.
ZSTD = {"parquet.compression.codec.zstd.level": "9"}

# Fixed values of the mu-law and A-law formats (ITU-T G.711), as rules.
_CODE = np.arange(256)


def mu_law_table() -> np.ndarray:
    u = ~_CODE & 0xFF
    magnitude = ((((u & 15) << 3) + 132) << ((u >> 4) & 7)) - 132
    return np.where(u & 0x80, -magnitude, magnitude).astype(np.int16)


def a_law_table() -> np.ndarray:
    a = _CODE ^ 0x55
    exponent, mantissa = (a >> 4) & 7, (a & 15) << 4
    magnitude = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, magnitude, -magnitude).astype(np.int16)


MU_LAW, A_LAW = mu_law_table(), a_law_table()


# Fixed values of IMA ADPCM: how the step index moves, and the 89 step sizes (each about a tenth more than the last).
INDEX_MOVE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767])


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """int16 samples (n, 121) of ADPCM blocks (n, 64) of uint8; the header's index is clipped to the table."""
    raw = np.ascontiguousarray(blocks, np.uint8)
    out = np.empty((len(raw), 1 + 2 * (BLOCK - 4)), np.int16)
    value = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(raw[:, 2], 88).astype(np.int32)
    out[:, 0] = value
    change = _adpcm_changes()
    for k in range(BLOCK - 4):
        byte = raw[:, 4 + k]
        for j, code in enumerate((byte & 15, byte >> 4)):
            at = index * 16 + code
            value = np.clip(value + change[0][at], -32768, 32767)
            index = change[1][at]
            out[:, 1 + 2 * k + j] = value
    return out


_CHANGES: list = []


def _adpcm_changes() -> tuple[np.ndarray, np.ndarray]:
    """For each step index and code: how the value changes, and the next index."""
    if not _CHANGES:
        step, code = np.repeat(STEPS, 16), np.tile(np.arange(16), 89)
        size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        _CHANGES.extend([np.where(code & 8, -size, size).astype(np.int32), np.clip(np.repeat(np.arange(89), 16) + INDEX_MOVE[code], 0, 88).astype(np.int32)])
    return _CHANGES[0], _CHANGES[1]


#: Half-band interpolation filter, times 32: the samples in between from three on each side.
HALF_BAND = (1, -5, 20)


def between_samples(pcm: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The filter's value between each sample and the next. Clips begin at starts; borders repeat."""
    n = len(pcm)
    clip = np.zeros(n, np.int32)
    clip[starts[1:][starts[1:] < n]] = 1
    first = starts[np.cumsum(clip)]
    last = np.append(starts[1:], n)[np.cumsum(clip)] - 1
    at, x = np.arange(n), pcm.astype(np.int32)
    between = np.zeros(n, np.int32)
    for k, w in enumerate(reversed(HALF_BAND)):
        between += w * (x[np.maximum(at - k, first)] + x[np.minimum(at + 1 + k, last)])
    return np.clip((between + 16) >> 5, -32768, 32767).astype(np.int16)


def resample_double(pcm: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample and the one between it and the next. Clips begin at starts; borders repeat."""
    if not len(pcm):
        return pcm
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2], out[1::2] = pcm, between_samples(pcm, starts)
    return out


def pcm_bytes(wide: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """16 kHz PCM of clips (of an even number of samples) as stored: every other sample, then the differences of those in between from
    the filter's values, modulo 65536; little-endian. Clips begin at starts, counted in pairs of samples."""
    even, odd = wide[0::2], wide[1::2]
    rest = (odd.view(np.uint16) - between_samples(even, starts).view(np.uint16)).astype("<u2")
    even = even.astype("<i2")
    return [even[a:b].tobytes() + rest[a:b].tobytes() for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(even)])]


def pcm_samples(stored: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 16 kHz PCM of clips that pcm_bytes() stored, joined, and where each begins, in pairs of samples."""
    halves = [np.frombuffer(b, "<i2").reshape(2, -1) for b in stored]
    even, rest = (np.concatenate([np.zeros(0, np.int16), *(h[k] for h in halves)]).astype(np.int16) for k in (0, 1))
    sizes = np.array([h.shape[1] for h in halves], np.int64)
    starts = np.cumsum(sizes) - sizes
    out = np.empty(2 * len(even), np.int16)
    out[0::2] = even
    if len(even):
        out[1::2] = (between_samples(even, starts).view(np.uint16) + rest.view(np.uint16)).view(np.int16)
    return out, starts


def wav(payload: bytes) -> bytes:
    """A mu-law WAV file; payload is its data as it is (of even length, as blocks are)."""
    body = b"WAVE" + b"fmt " + struct.pack("<IHHIIHHH", 18, 7, 1, RATE, RATE, 1, 8, 0) + b"fact" + struct.pack("<II", 4, len(payload)) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


WAV_HEADER = len(wav(b""))


def payload_of(media: bytes) -> bytes:
    """The samples of a file that wav() made."""
    (n,) = struct.unpack_from("<I", media, WAV_HEADER - 4)
    return media[WAV_HEADER : WAV_HEADER + n]


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def _encode(batches):
    for batch in batches:
        raw = [t.encode() for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([wav(padded(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])


def _resample(batches):
    for batch in batches:
        for part in _work(batch):
            payloads = [payload_of(m) for m in part.column(2).to_pylist()]
            lens = np.array([len(p) for p in payloads])
            starts = np.cumsum(lens) - lens
            wide = resample_double(MU_LAW[np.frombuffer(b"".join(payloads), np.uint8)], starts)
            yield pa.record_batch([*part.columns, pa.array(pcm_bytes(wide, starts), pa.binary())], ["doc_id", "n_bytes", "media", "pcm"])


_CLIP = "doc_id long, n_bytes long, media binary"


def encode_clips(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as a clip."""
    return clean_docs(docs).mapInArrow(_encode, _CLIP)


def with_pcm(clips: DataFrame) -> DataFrame:
    """Clips with a column pcm: their mu-law samples, resampled to 16 kHz, as pcm_bytes() has them."""
    return clips.select("doc_id", "n_bytes", "media").mapInArrow(_resample, f"{_CLIP}, pcm binary")


def clips_with_pcm(docs: DataFrame) -> DataFrame:
    """with_pcm(encode_clips(docs)) in one Python worker a task."""
    return clean_docs(docs).mapInArrow(lambda batches: _resample(_encode(batches)), f"{_CLIP}, pcm binary")


def _features(payloads: list[bytes], stored: list[bytes]) -> list[str]:
    """Loudness and crossings of the mu-law and A-law readings, checksums of the stored 16 kHz PCM and of the ADPCM reading."""
    lens = np.array([len(p) for p in payloads])
    starts = np.cumsum(lens) - lens
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    said = []
    for name, table in (("mu", MU_LAW), ("a", A_LAW)):
        pcm = table[raw]
        square = np.add.reduceat(pcm.astype(np.int64) ** 2, starts)
        cross = np.add.reduceat(np.append((pcm[1:] < 0) != (pcm[:-1] < 0), False).astype(np.int64), starts)
        inner = starts[1:] - 1
        cross[:-1] -= (pcm[inner] < 0) != (pcm[inner + 1] < 0)
        peak = np.maximum.reduceat(np.abs(pcm.astype(np.int32)), starts)
        said.append([f"{name}:rms={int(s // n)},peak={p},zc={c}" for s, n, p, c in zip(square.tolist(), lens.tolist(), peak.tolist(), cross.tolist())])
    wide, begin = pcm_samples(stored)
    view = memoryview(wide.astype("<i2").tobytes())
    ends = [*begin[1:].tolist(), len(wide) // 2]
    adpcm = decode_adpcm(raw.reshape(-1, BLOCK)).astype("<i2")
    mean = np.add.reduceat(np.abs(adpcm.astype(np.int64)).sum(axis=1), starts // BLOCK) // (lens // BLOCK * adpcm.shape[1])
    said.append([f"pcm16k:n={2 * (b - a)},crc={zlib.crc32(view[4 * a : 4 * b])}" for a, b in zip(begin.tolist(), ends)])
    said.append([f"adpcm:mean={m}" for m in mean.tolist()])
    return ["|".join(x) for x in zip(*said)]


def _work(batch: pa.RecordBatch):
    """Slices of a batch of clips of at most WORK_BYTES, one clip at least."""
    i, n = 0, 0
    for j, m in enumerate(pa.compute.binary_length(batch.column(2)).to_pylist()):
        if j > i and n + m > WORK_BYTES:
            yield batch.slice(i, j - i)
            i, n = j, 0
        n += m
    if batch.num_rows > i:
        yield batch.slice(i)


def clip_features(clips: DataFrame) -> DataFrame:
    """What is read back from stored clips and their PCM: sizes, checksums and features."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches):
        for batch in batches:
            for part in _work(batch):
                media, pcm = part.column(2).to_pylist(), part.column(3).to_pylist()
                payloads = [payload_of(m) for m in media]
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([zlib.crc32(p[-BLOCK:]) for p in payloads], pa.int64()), pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(_features(payloads, pcm))],
                    names,
                )

    return clips.select("doc_id", "n_bytes", "media", "pcm").mapInArrow(read, schema)


def decoded(clips: DataFrame, codec: str = "mu") -> DataFrame:
    """(doc_id, rate, pcm): 16-bit little-endian samples; codec is mu, a (both resampled to 16 kHz) or adpcm (8 kHz)."""
    if codec not in ("mu", "a", "adpcm"):
        raise ValueError(codec)

    def read(batches):
        for batch in batches:
            pcm = []
            for m in batch.column(1).to_pylist():
                raw = np.frombuffer(payload_of(m), np.uint8)
                x = decode_adpcm(raw.reshape(-1, BLOCK)).ravel() if codec == "adpcm" else resample_double((MU_LAW if codec == "mu" else A_LAW)[raw], np.zeros(1, np.int64))
                pcm.append(x.astype("<i2").tobytes())
            yield pa.record_batch([batch.column(0), pa.array([RATE if codec == "adpcm" else 2 * RATE] * len(pcm), pa.int32()), pa.array(pcm, pa.binary())], ["doc_id", "rate", "pcm"])

    return clips.select("doc_id", "media").mapInArrow(read, "doc_id long, rate int, pcm binary")


def store_pcm(clips: DataFrame, path: str, codec: str = "mu") -> None:
    """Writes decoded clips as a Parquet column of 16-bit PCM."""
    decoded(clips, codec).write.option("compression", "zstd").parquet(path)


def telephony(docs: DataFrame) -> DataFrame:
    """Stores every text as a clip with its resampled PCM in the shared folder, reads the stored bytes back and computes their features."""
    return clip_features(written(clips_with_pcm(docs), "clips", ZSTD))
