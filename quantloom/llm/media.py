"""Telephony audio columns: companded and adaptive codings to PCM, in numpy across all samples or blocks of a column.

mu-law and A-law bytes expand by 256-entry tables built from the ITU-T G.711 segment rule.  IMA ADPCM (mono, four bits) is decoded
block by block in the file's sense but across blocks in ours: step t of every block of a batch is one numpy operation, so the Python
loop is as long as one block.  Everything is resampled to one rate by a windowed-sinc polyphase filter and stored as 16-bit PCM WAV.
Stored samples are read back from the WAV bytes, never taken from what was written.

Defined results: a null or empty payload becomes one frame of padding where a frame length is asked for, else no samples; a WAV that
cannot be read gives null results; sizes are only bounded by a row's own; equal inputs give equal results; an empty table gives an
empty one; other columns are left out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
RATE_IN, RATE_OUT = 8000, 16000


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: inverted bits; sign, segment, step; bias 33 in 14 bits, here at 16."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    segment, step = (code >> 4) & 7, code & 15
    size = ((2 * step + 33) << (segment + 2)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: even bits inverted; the first segment is linear."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, step = (code >> 4) & 7, code & 15
    size = np.where(segment == 0, (step << 4) + 8, ((step << 4) + 264) << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def ima_steps() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM: 7 growing by a tenth, as the format rounds it down.

    s(0) = 7 and s(n + 1) is close to 1.1 s(n); the published table is this list of fixed values:"""
    # Fixed values of the IMA ADPCM format.
    return np.array(
        [
            7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
            130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
            1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
            7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
        ],
        np.int32,
    )


MULAW_PCM, ALAW_PCM, IMA_STEPS = mulaw_table(), alaw_table(), ima_steps()
#: Fixed values of the format: how a four-bit code moves the step index.
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def ima_blocks(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks, one per row (uint8): header of sample, index, a spare byte; then two codes a byte, low one first."""
    head = blocks[:, :4].astype(np.int32)
    sample = (head[:, 0] | head[:, 1] << 8).astype(np.uint16).view(np.int16).astype(np.int32)
    index = np.clip(head[:, 2], 0, 88)
    codes = np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], 2).reshape(len(blocks), -1).astype(np.int32)
    out = np.empty((len(blocks), codes.shape[1] + 1), np.int16)
    out[:, 0] = sample
    for t in range(codes.shape[1]):
        code, step = codes[:, t], IMA_STEPS[index]
        size = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
        sample = np.clip(np.where(code & 8, sample - size, sample + size), -32768, 32767)
        index = np.clip(index + IMA_MOVES[code & 7], 0, 88)
        out[:, t + 1] = sample
    return out


def wav(data: bytes, form: int, rate: int = RATE_IN, block: int = 1) -> bytes:
    """A mono WAV file around coded data.  An odd length is padded by a zero byte that the sizes leave out."""
    bits = {PCM: 16, IMA: 4}.get(form, 8)
    align = {PCM: 2, IMA: block}.get(form, 1)
    extra = struct.pack("<HH", 2, (block - 4) * 2 + 1) if form == IMA else b"" if form == PCM else struct.pack("<H", 0)
    per_second = rate * align if form != IMA else rate * block // ((block - 4) * 2 + 1)
    fmt = struct.pack("<HHIIHH", form, 1, rate, per_second, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(raw: bytes | None) -> tuple[int, int, int, bytes] | None:
    """Format, rate, block length and data of a mono WAV file; None if it is none."""
    if not raw or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
        part = raw[at + 8 : at + 8 + size]
        if name == b"fmt " and len(part) >= 16:
            fmt = struct.unpack("<HHIIHH", part[:16])
        elif name == b"data" and fmt and fmt[1] == 1 and fmt[0] in (PCM, ALAW, MULAW, IMA):
            return fmt[0], fmt[2], fmt[4], part
        at += 8 + size + size % 2
    return None


def decode(data: bytes, form: int, block: int = 256) -> np.ndarray:
    """Coded data as 16-bit PCM."""
    raw = np.frombuffer(data, np.uint8)
    if form == MULAW:
        return MULAW_PCM[raw]
    if form == ALAW:
        return ALAW_PCM[raw]
    if form == IMA:
        whole = len(raw) // block
        out = [ima_blocks(raw[: whole * block].reshape(whole, block)).ravel()] if whole else []
        if len(raw) - whole * block > 4:
            out.append(ima_blocks(raw[whole * block :][None]).ravel())
        return np.concatenate(out) if out else np.zeros(0, np.int16)
    return np.frombuffer(data[: len(data) // 2 * 2], "<i2")


def resample(pcm: np.ndarray, rate: int, to: int = RATE_OUT, half: int = 8) -> np.ndarray:
    """16-bit PCM at another rate: a polyphase filter, sinc under a Hann window, 2 * half taps a phase, cut at the lower rate."""
    if rate == to or not len(pcm):
        return pcm
    from math import gcd

    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    n = -(-len(pcm) * up // down)
    t = np.arange(up, dtype=np.float64) * down
    cut = min(1.0, to / rate)
    taps = np.arange(-half + 1, half + 1)
    # Output k * up + p lies at input k * down + whole[p] + part[p].
    whole, part = (t // up).astype(np.int64), (t % up) / up
    x = taps[None] - part[:, None]
    bank = cut * np.sinc(cut * x) * (0.5 + 0.5 * np.cos(np.pi * np.clip(x / half, -1, 1)))
    bank = (bank / bank.sum(1, keepdims=True)).astype(np.float32)
    padded = np.pad(pcm.astype(np.float32), (half - 1, half + down + up))
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * half)
    out = np.empty((-(-n // up), up), np.float32)
    for p in range(up):
        w = windows[whole[p] :: down][: len(out)]
        if bank[p].max() > 0.999999:  # a phase on the grid: the sample itself
            out[: len(w), p] = w[:, half - 1]
        else:
            out[: len(w), p] = w @ bank[p]
    return np.clip(np.rint(out.ravel()[:n]), -32768, 32767).astype(np.int16)


def features(pcm: np.ndarray) -> str:
    """Level, peak, share of sign changes and mean step of PCM, as text with fixed digits."""
    if not len(pcm):
        return "n=0"
    x = pcm.astype(np.float64)
    crossed = np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)) / max(len(pcm) - 1, 1)
    step = np.abs(np.diff(pcm.astype(np.int32))).mean() if len(pcm) > 1 else 0.0
    return f"n={len(pcm)};rms={np.sqrt((x * x).mean()):.3f};peak={int(np.abs(pcm.astype(np.int32)).max())};zcr={crossed:.6f};step={step:.3f}"


#: Codings of stored payloads, by the remainder of their checksum; the block length of the adaptive one.
CODINGS, BLOCK = (MULAW, ALAW, IMA), 576


def decoded(files: list[tuple[int, int, int, bytes] | None]) -> list[np.ndarray | None]:
    """PCM of what unwav read.  ADPCM blocks of one length are decoded together, whatever files they come from."""
    pcm: list[np.ndarray | None] = [decode(f[3], f[0], f[2]) if f and f[0] != IMA else None for f in files]
    for length in {f[2] for f in files if f and f[0] == IMA and f[2] > 4}:
        mine = [i for i, f in enumerate(files) if f and f[0] == IMA and f[2] == length]
        whole = [len(files[i][3]) // length for i in mine]
        both = np.concatenate([np.frombuffer(files[i][3], np.uint8)[: w * length].reshape(w, length) for i, w in zip(mine, whole, strict=True)])
        parts = np.split(ima_blocks(both), np.cumsum(whole)[:-1])
        for i, w, p in zip(mine, whole, parts, strict=True):
            rest = files[i][3][w * length :]
            pcm[i] = np.concatenate([p.ravel(), decode(rest, IMA, len(rest))]) if len(rest) > 4 else p.ravel()
    return pcm


def stored_payloads(docs: DataFrame, frame: int = 576, fill: int = 255, doc_id: str = "doc_id", text: str = "text", files: bool = False, rate: int = RATE_OUT) -> DataFrame:
    """Texts as telephone audio: UTF-8, padded with `fill` to a positive multiple of `frame` bytes (the payload), stored in a WAV file whose
    coding (mu-law, A-law, IMA ADPCM in blocks of BLOCK) the payload's CRC chooses, read back, expanded or decoded, resampled, and stored
    as PCM.  A row for each document: doc_id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of the bytes read back), feature (of
    the PCM read back), coding, and media_bytes, media_sha256, pcm_bytes and pcm_sha256 of the two files, or with `files` the files
    themselves, media and pcm_wav."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in common.texts(batch, "text")]
            media = []
            for raw in raws:
                payload = raw + bytes([fill]) * (-len(raw) % frame if raw else frame)
                form = CODINGS[zlib.crc32(payload) % len(CODINGS)]
                media.append(wav(payload, form, block=BLOCK))
            read = [unwav(m) for m in media]
            pcm = [wav(resample(p, f[1], rate).astype("<i2").tobytes(), PCM, rate) for p, f in zip(decoded(read), read, strict=True)]
            back = [decode(unwav(w)[3], PCM) for w in pcm]
            stored = [media, pcm] if files else [c for both in (media, pcm) for c in ([len(m) for m in both], [hashlib.sha256(m).hexdigest() for m in both])]
            columns = [
                [len(r) for r in raws], [len(f[3]) for f in read], [hashlib.sha256(f[3]).hexdigest() for f in read], [zlib.crc32(f[3][-32:]) for f in read],
                [features(b) for b in back], [f[0] for f in read], *stored,
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, kinds[t]) for c, (_, t) in zip(columns, out[1:], strict=True))], [n for n, _ in out])

    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    out = [("doc_id", "long"), ("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("feature", "string"), ("coding", "int")]
    out += [("media", "binary"), ("pcm_wav", "binary")] if files else [("media_bytes", "long"), ("media_sha256", "string"), ("pcm_bytes", "long"), ("pcm_sha256", "string")]
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return common.mapped(source, run, ", ".join(f"{n} {t}" for n, t in out))


def to_pcm(media: DataFrame, key: str, column: str, rate: int = RATE_OUT) -> DataFrame:
    """key, pcm_wav (16-bit PCM at `rate`; null where the column holds no readable WAV), n_samples and feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "media"):
            files = [unwav(m) for m in common.texts(batch, "media")]
            out = [None if p is None else resample(p, f[1], rate) for p, f in zip(decoded(files), files, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([None if p is None else wav(p.astype("<i2").tobytes(), PCM, rate) for p in out], pa.binary()),
                    pa.array([None if p is None else len(p) for p in out], pa.int64()),
                    pa.array([None if p is None else features(p) for p in out], pa.string()),
                ],
                ["key", "pcm_wav", "n_samples", "feature"],
            )

    source = media.select(F.col(key).alias("key"), F.col(column).alias("media"))
    kind = source.schema["key"].dataType.simpleString()
    return common.mapped(source, run, f"key {kind}, pcm_wav binary, n_samples long, feature string").withColumnRenamed("key", key)
