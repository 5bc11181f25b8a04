"""Telephony audio columns: mu-law and A-law by lookup tables, IMA ADPCM across blocks, resampled PCM.

A payload is kept losslessly as the 8-bit samples of a mu-law WAV file (one byte, one sample) in a table of
media; parsing the file gives the bytes back, and expanding them gives 16-bit PCM. The same PCM is encoded as A-law
and as ADPCM blocks and decoded again. ADPCM blocks are coded all at once: the loop runs over the samples
of a block, numpy over the blocks. Media of all three kinds are stored as resampled PCM by resample_media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinescribe.llm.common import pieces, shared_table, text_column

RATE = 8000
UNIT = 576
FORMATS = {"pcm": 1, "alaw": 6, "mulaw": 7, "adpcm": 17}


def mulaw_table() -> np.ndarray:
    """16-bit values of the 256 mu-law codes: inverted bits, sign, 3-bit exponent, 4-bit mantissa, bias 132."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit values of the 256 A-law codes: even bits inverted, sign, 3-bit segment, 4-bit mantissa."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(segment == 0, low + 8, (low + 264) << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()

# Fixed values of the IMA ADPCM format: step sizes, and the change of the step index for each code.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
# The change that each (step index, 4-bit code) makes, and the next step index.
_CODE = np.arange(16)
_S = STEPS[:, None]
_SIZE = (_S >> 3) + np.where(_CODE & 4, _S, 0) + np.where(_CODE & 2, _S >> 1, 0) + np.where(_CODE & 1, _S >> 2, 0)
CHANGE = np.where(_CODE & 8, -_SIZE, _SIZE).astype(np.int32).ravel()
NEXT = (np.clip(np.arange(89)[:, None] + INDEX[_CODE & 7], 0, 88) * 16).astype(np.int32).ravel()


#: Bytes of an ADPCM block, and the samples that it holds.
BLOCK = 36
SAMPLES = 2 * (BLOCK - 4) + 1


def decode_adpcm(data: np.ndarray, block: int) -> np.ndarray:
    """Mono IMA ADPCM blocks of `block` bytes to PCM, one row a block: header (predictor, step index,
    unused byte), then two codes a byte, the lower half first. A step index over 88 counts as 88."""
    rows = data[: len(data) // block * block].reshape(-1, block)
    value = rows[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    step = np.minimum(rows[:, 2], 88).astype(np.int32) * 16
    codes = np.ascontiguousarray(rows[:, 4:].T)
    out = np.empty((2 * (block - 4) + 1, len(rows)), np.int16)
    out[0] = value
    for i, byte in enumerate(codes):
        for half, code in enumerate((byte & 15, byte >> 4)):
            step += code
            value += CHANGE[step]
            np.clip(value, -32768, 32767, out=value)
            step = NEXT[step]
            out[1 + 2 * i + half] = value
    return out.T


def encode_by(table: np.ndarray, pcm: np.ndarray) -> np.ndarray:
    """The code of each sample whose value in the table is nearest (the lower value of equals)."""
    order = np.argsort(table, kind="stable")
    value = table[order].astype(np.int32)
    every = np.arange(-32768, 32768)
    above = np.minimum(np.searchsorted(value, every), len(value) - 1)
    below = np.maximum(above - 1, 0)
    nearest = np.where(every - value[below] <= value[above] - every, below, above)
    return order[nearest].astype(np.uint8)[pcm.astype(np.int32) + 32768]


def adpcm_blocks(starts: np.ndarray, sizes: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sample each place of each block holds, for clips cut into blocks of `samples` (a clip's last block is
    filled with its last sample), and the first block of each clip."""
    count = -(-sizes // samples)
    first = np.add.accumulate(count) - count
    clip = np.repeat(np.arange(len(sizes)), count)
    at = (np.arange(len(clip)) - first[clip]) * samples
    return starts[clip, None] + np.minimum(at[:, None] + np.arange(samples), sizes[clip, None] - 1), first


def encode_adpcm(rows: np.ndarray) -> np.ndarray:
    """PCM, one row of an odd number of samples a block, to mono IMA ADPCM blocks. A block starts at the step nearest
    to the mean change of its samples."""
    x = rows.astype(np.int32)
    n = x.shape[1]
    mean = np.abs(np.diff(x, axis=1)).sum(1) // max(1, n - 1)
    step = np.minimum(np.searchsorted(STEPS, mean), 88).astype(np.int32)
    out = np.zeros((len(x), 4 + (n - 1) // 2), np.uint8)
    out[:, :2] = x[:, :1].astype("<i2").view(np.uint8)
    out[:, 2] = step
    value, step = x[:, 0].copy(), step * 16
    for i in range(1, n):
        size = STEPS[step >> 4]
        off = x[:, i] - value
        left = np.abs(off)
        code = np.where(off < 0, 8, 0)
        for bit in (4, 2, 1):
            big = left >= size
            code += np.where(big, bit, 0)
            left = np.where(big, left - size, left)
            size = size >> 1
        value = np.clip(value + CHANGE[step + code], -32768, 32767)
        step = NEXT[step + code]
        out[:, 4 + (i - 1) // 2] |= (code << (4 if i % 2 == 0 else 0)).astype(np.uint8)
    return out


def resample_double(pcm: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Twice the sample rate for consecutive clips that begin at starts: samples stay, and between
    two a four-point half-band filter (-1, 9, 9, -1) / 16 sets one; ends repeat."""
    x = pcm.astype(np.int32)
    n = len(x)
    out = np.empty(2 * n, np.int16)
    out[::2] = pcm
    if n:
        at = np.arange(n)
        last = np.concatenate((starts[1:], [n])) - 1
        before, after, beyond = at - 1, at + 1, at + 2
        before[starts], after[last], beyond[last] = starts, last, last
        inner = last[last > starts] - 1
        beyond[inner] = inner + 1
        out[1::2] = np.clip((9 * (x + x[after]) - x[before] - x[beyond] + 8) >> 4, -32768, 32767)
    return out


TO_ALAW = encode_by(ALAW, np.arange(-32768, 32768))


def wav(samples: bytes, kind: str, rate: int = RATE, bits: int = 8) -> bytes:
    """A mono RIFF file; formats other than PCM have an extended header and a fact chunk."""
    align = bits // 8
    head = struct.pack("<HHIIHH", FORMATS[kind], 1, rate, rate * align, align, bits)
    chunks = b"fmt " + struct.pack("<I", len(head)) + head
    if kind != "pcm":
        chunks = b"fmt " + struct.pack("<I", len(head) + 2) + head + b"\0\0" + b"fact" + struct.pack("<II", 4, len(samples) // align)
    chunks += b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(media: bytes) -> tuple[int, int, bytes]:
    """Format code, sample rate and the data chunk's bytes."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, code, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            code, _, rate = struct.unpack_from("<HHI", media, at + 8)
        if name == b"data":
            return code, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of UNIT."""
    return data + b"\xff" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def features(payloads: list[bytes]) -> list[str]:
    """Of each payload's samples: level, peak, zero crossings and roughness of the mu-law PCM; the level of that PCM
    after A-law, and its mean error; the same after ADPCM; and a checksum of the PCM resampled to 16 kHz. Integer
    sums, so equal payloads have equal features wherever they stand."""
    sizes = np.array([len(x) for x in payloads], np.int64)
    starts = np.add.accumulate(sizes) - sizes
    data = np.frombuffer(b"".join(payloads), np.uint8)
    pcm = MULAW[data]
    wide = pcm.astype(np.int64)
    energy = np.add.reduceat(wide * wide, starts)
    peak = np.maximum.reduceat(np.abs(wide), starts)
    step = np.diff(wide, prepend=0)
    step[starts] = 0
    cross = np.diff((pcm < 0).view(np.int8), prepend=0) != 0
    cross[starts] = False
    rough, zero = np.add.reduceat(np.abs(step), starts), np.add.reduceat(cross.astype(np.int64), starts)
    law = ALAW[TO_ALAW[pcm.astype(np.int32) + 32768]].astype(np.int64)
    alaw, alaw_off = np.add.reduceat(np.abs(law), starts), np.add.reduceat(np.abs(law - wide), starts)
    held, first = adpcm_blocks(starts, sizes, SAMPLES)
    blocks = decode_adpcm(encode_adpcm(pcm[held]).ravel(), BLOCK).astype(np.int64)
    count = len(held[0]) * np.diff(np.concatenate((first, [len(held)])))
    adpcm, adpcm_off = (np.add.reduceat(np.abs(v).sum(axis=1), first) for v in (blocks, blocks - pcm[held]))
    fine = resample_double(pcm, starts)
    out = []
    for i, (at, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
        crc = zlib.crc32(fine[2 * at : 2 * (at + n)].tobytes())
        out.append(f"rms={np.sqrt(energy[i] / n):.3f};peak={peak[i]};zero={zero[i]};rough={rough[i] / n:.3f};alaw={alaw[i] / n:.3f},{alaw_off[i] / n:.3f};adpcm={adpcm[i] / count[i]:.3f},{adpcm_off[i] / count[i]:.3f};pcm16k={crc:08x}")
    return out


def encoded_wav(pcm: np.ndarray, kind: str) -> bytes:
    """PCM at 8 kHz as a mu-law, A-law or ADPCM file; an ADPCM file is filled up to a whole block."""
    if kind == "adpcm":
        rows = adpcm_blocks(np.zeros(1, np.int64), np.array([len(pcm)]), SAMPLES)[0] if len(pcm) else np.zeros((0, SAMPLES), np.int64)
        return wav(encode_adpcm(pcm[rows]).tobytes(), kind)
    return wav(encode_by(MULAW if kind == "mulaw" else ALAW, pcm).tobytes(), kind)


def pcm_wav(media: bytes, rate: int = 2 * RATE) -> bytes:
    """A mu-law, A-law or ADPCM file (blocks of 36 bytes) as a 16-bit PCM file, at 8 or 16 kHz."""
    code, _, data = read_wav(media)
    view = np.frombuffer(data, np.uint8)
    pcm = MULAW[view] if code == 7 else ALAW[view] if code == 6 else decode_adpcm(view, BLOCK).ravel()
    if rate == 2 * RATE:
        pcm = resample_double(pcm, np.zeros(min(1, len(pcm)), np.int64))
    return wav(pcm.astype("<i2").tobytes(), "pcm", rate, 16)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, at in pieces(batches, "media"):
        stored = [data[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        read = [read_wav(x)[2] for x in stored]
        sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("n_bytes"), pa.array([len(x) for x in read], pa.int64()), sha(read),
            pa.array([zlib.crc32(x[-32:]) for x in read], pa.int64()), pa.array([len(x) for x in stored], pa.int64()), sha(stored), pa.array(features(read)),
        ], names=_NAMES)


def store_payloads(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The media table: (doc_id, n_bytes, media), each text's padded UTF-8 bytes as a mu-law file. Null texts are
    empty; each row has its file, those without doc_id and repeated ones too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in pieces(batches, "__bytes"):
            media = [wav(pad(data[a : b - 1].tobytes()), "mulaw") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at) - 1), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_column(text).alias("__bytes")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def resample_media(media: DataFrame, column: str = "media", rate: int = 2 * RATE) -> DataFrame:
    """Replaces a column of telephony files by 16-bit PCM files at `rate`; null stays null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                yield part.set_column(at, column, pa.array([None if x is None else pcm_wav(x, rate) for x in part.column(at).to_pylist()], pa.binary()))

    return media.mapInArrow(run, media.schema)


def media_digests(media: DataFrame) -> DataFrame:
    """Payload digests and features of a media table (doc_id, n_bytes, media), from the bytes as they are read."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digest, SCHEMA)


def payload_digests(docs: DataFrame) -> DataFrame:
    """Writes each text's padded UTF-8 bytes as a mu-law file into a table of media in the shared folder, reads the
    table back, and returns the files' digests and features. Nothing is shuffled; memory follows the longest
    text. A null text is empty (576 bytes of padding); repeated rows give repeated results; an empty table
    gives an empty result; other columns are not read."""
    return media_digests(shared_table(store_payloads(docs), "media", "zstd"))
