"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM in WAV, decoded by numpy.

mu-law and A-law bytes expand through tables of 256 values, made from the formats' bit fields. ADPCM
blocks are decoded side by side: the steps of a block follow each other, but each step is one array
operation over all blocks of a batch. Decoded samples are resampled to whole multiples of their rate
by linear interpolation in whole numbers, and stored as 16-bit PCM in WAV.

Media that are null, no WAV file, cut short or of an unknown format don't stop a job: their row says
so in the column fault, and has nulls for what can't be told.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorespan.llm.common import plain, small_batches, utf8

RATE, UNIT = 8000, 64
#: Bytes of texts or media that a Python worker gets at once; it makes about twelve times that of them.
BATCH = 4 << 20
#: WAV format tags.
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 0x11

# Fixed values of the IMA ADPCM format: step sizes, and how the index moves with a code's magnitude.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def _mulaw() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    power = code >> 4 & 7
    size = ((code & 15) << 4) + 8
    size = np.where(power > 0, size + 256 << np.maximum(power - 1, 0), size)
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw(), _alaw()
#: What a nibble adds to the predictor, by step index.
DELTAS = np.array([[(-1 if n & 8 else 1) * ((s >> 3) + (s if n & 4 else 0) + (s >> 1 if n & 2 else 0) + (s >> 2 if n & 1 else 0)) for n in range(16)] for s in STEPS.tolist()], np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """int16 samples of blocks (one a row: predictor, step index, a spare byte, then nibbles, the low one first)."""
    blocks = np.atleast_2d(blocks)
    n, width = blocks.shape
    nibbles = np.empty(((width - 4) * 2, n), np.uint8)
    nibbles[0::2], nibbles[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(nibbles) + 1, n), np.int16)
    at = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out[0] = at
    for i, nibble in enumerate(nibbles):
        at = np.clip(at + DELTAS[index, nibble], -32768, 32767)
        index = np.clip(index + MOVES[nibble & 7], 0, len(STEPS) - 1)
        out[i + 1] = at
    return out.T


def wav(data: bytes, tag: int = MULAW, rate: int = RATE, block: int = 1) -> bytes:
    """One channel: 8-bit codes of G.711, 16-bit PCM, or ADPCM blocks of `block` bytes. The data are stored as they are."""
    bits = {PCM: 16, ADPCM: 4}.get(tag, 8)
    align = {PCM: 2, ADPCM: block}.get(tag, 1)
    extra = struct.pack("<HH", 2, (block - 4) * 2 + 1) if tag == ADPCM else b"" if tag == PCM else struct.pack("<H", 0)
    bytes_a_second = rate * align // ((block - 4) * 2 + 1) if tag == ADPCM else rate * align
    head = struct.pack("<HHIIHH", tag, 1, rate, bytes_a_second, align, bits) + extra
    body = b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


class Fault(ValueError):
    """What is wrong with a media file."""


def unwav(media: bytes | None) -> tuple[int, int, int, bytes]:
    """Format tag, rate, bytes of a block and data of a WAV file; other chunks are passed over."""
    if media is None:
        raise Fault("no media")
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise Fault("not a WAV file")
    at, tag, rate, align = 12, 0, 0, 1
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            if size < 16 or at + 24 > len(media):
                raise Fault("a broken format chunk")
            tag, channels, rate, _, align, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            if tag not in (PCM, ALAW, MULAW, ADPCM):
                raise Fault(f"unknown format {tag}")
            if channels != 1 or align < 1 or tag == ADPCM and align < 5:
                raise Fault(f"unknown layout of format {tag}")
        elif name == b"data":
            if not tag:
                raise Fault("data before the format")
            if at + 8 + size > len(media):
                raise Fault("data cut short")
            return tag, rate, align, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise Fault("no data")


def resample(pcm: np.ndarray, times: int = 2) -> np.ndarray:
    """int16 samples at a rate `times` as high; in between them, the rounded linear interpolation; the last one is held."""
    if times == 1 or not len(pcm):
        return pcm.astype(np.int16)
    wide = np.r_[pcm, pcm[-1:]].astype(np.int32)
    out = np.empty((len(pcm), times), np.int16)
    for i in range(times):
        out[:, i] = (wide[:-1] * (times - i) + wide[1:] * i + times // 2) // times
    return out.ravel()


def samples(tag: int, align: int, data: bytes) -> np.ndarray:
    """int16 samples of stored data; a last block or sample that isn't whole is left out."""
    if tag == ADPCM:
        raw = np.frombuffer(data, np.uint8)
        return decode_adpcm(raw[: len(raw) // align * align].reshape(-1, align)).ravel() if len(raw) >= align else np.zeros(0, np.int16)
    if tag == PCM:
        return np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    return (ALAW_TABLE if tag == ALAW else MULAW_TABLE)[np.frombuffer(data, np.uint8)]


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def measures(pcm: np.ndarray) -> str:
    """Length, peak, sum of squares, sign changes and mean step, in whole numbers."""
    x = pcm.astype(np.int64)
    steps = np.abs(np.diff(x))
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"{len(x)},{int(np.abs(x).max(initial=0))},{int((x * x).sum())},{crossings},{int(steps.sum()) // max(1, len(steps))}"


def store(docs: DataFrame, tag: int = MULAW) -> DataFrame:
    """doc_id, n_bytes, media: each text of docs (doc_id, text), as UTF-8 with bytes 0 up to a positive multiple of UNIT, as the samples of a WAV file.

    A null text is an empty one and has UNIT bytes 0. doc_id may be of any type, texts of any length.
    Repeated rows come back as often; other columns are left aside; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession, size=BATCH)

    def run(batches):
        for batch in batches:
            texts = utf8(batch.column("text")).to_pylist()
            media = [wav(payload(t), tag, block=UNIT) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    docs = plain(docs, "doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


_DIGESTS = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "pcm_sha256": pa.string(), "pcm": pa.binary(), "fault": pa.string()}


def decode(media: DataFrame, times: int = 2) -> DataFrame:
    """The columns of rows (media, and others of other names than these) and, of the bytes that media hold: payload_bytes, payload_sha256, tail_crc32 (of the last UNIT bytes), media_bytes, media_sha256, feature, pcm_sha256, pcm (a WAV file of resampled 16-bit PCM), fault.

    feature has measures of the payload's samples expanded by the stored format's table, by the other
    one of mu-law and A-law, and decoded as ADPCM blocks of UNIT bytes, all blocks of a batch at once.
    Where media are null or broken, fault says why, and what can't be told is null. Media may be empty,
    or of any length; repeated rows come back as often; an empty table gives an empty one.
    """
    small_batches(media.sparkSession, size=BATCH)
    kept = [c for c in media.columns if c not in _DIGESTS and c != "media"]
    names = [*kept, "media", *_DIGESTS]

    def run(batches):
        for batch in batches:
            stored, parts, faults = batch.column("media").to_pylist(), [], []
            for x in stored:
                try:
                    parts.append(unwav(x))
                    faults.append(None)
                except Fault as fault:
                    parts.append((0, 0, 1, b""))
                    faults.append(str(fault))
            ends = np.cumsum([0, *(len(data) // UNIT for *_, data in parts)])
            every = np.frombuffer(b"".join(data[: len(data) // UNIT * UNIT] for *_, data in parts), np.uint8).reshape(-1, UNIT)
            blocks = decode_adpcm(every)
            rows = []
            for i, ((tag, rate, align, data), fault) in enumerate(zip(parts, faults, strict=True)):
                known = (None, None) if stored[i] is None else (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
                if fault:
                    rows.append((None, None, None, *known, None, None, None, fault))
                    continue
                pcm = resample(samples(tag, align, data), times).astype("<i2").tobytes()
                other = (MULAW_TABLE if tag == ALAW else ALAW_TABLE)[np.frombuffer(data, np.uint8)]
                feature = f"{tag}:{measures(np.frombuffer(pcm, '<i2'))};{measures(other)};{measures(blocks[ends[i] : ends[i + 1]].ravel())}"
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), *known, feature, hashlib.sha256(pcm).hexdigest(), wav(pcm, PCM, rate * times), None))
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_DIGESTS.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*kept, "media")), *made], names)

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    schema = [*(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in kept), "media binary", *(f"{c} {kinds[t]}" for c, t in _DIGESTS.items())]
    return media.select(*kept, "media").mapInArrow(run, ", ".join(schema))


def archive(docs: DataFrame, folder: str, tag: int = MULAW, times: int = 2) -> DataFrame:
    """The rows of decode(store(docs)) without media, by way of a Parquet table of media in folder: all but n_bytes is made of what is read back from it. Resampled PCM is stored with the result, as its column pcm."""
    spark = docs.sparkSession
    store(docs, tag).write.option("compression", "zstd").parquet(folder)
    return decode(spark.read.parquet(folder), times).drop("media")
