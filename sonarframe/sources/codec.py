"""PCM containers: reading WAV and AIFF, writing WAV with cue points.

``decode`` turns a binaryFile table into signals; what can't be read becomes an error
column and no job fails on it.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sonarframe.functions import udf

SIGNAL = "path string, sample_rate int, channels array<array<float>>, error string"


class Unsupported(ValueError):
    pass


def _pcm(data: bytes, bits: int, big: bool, channels: int, floating: bool = False) -> np.ndarray:
    """Interleaved samples as float32 (channel, frame) in -1..1; what doesn't fill a frame is dropped."""
    size = bits // 8 * channels
    data = data[: len(data) // size * size]
    order = ">" if big else "<"
    if floating and bits == 32:
        x = np.frombuffer(data, f"{order}f4").astype(np.float32)
    elif bits == 8:
        x = np.frombuffer(data, np.int8).astype(np.float32) / 128 if big else (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    elif bits == 16:
        x = np.frombuffer(data, f"{order}i2").astype(np.float32) / 32768
    elif bits == 24:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        b = b[:, ::-1] if big else b
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        x = ((v ^ 0x800000) - 0x800000).astype(np.float32) / 8388608
    elif bits == 32:
        x = (np.frombuffer(data, f"{order}i4") / 2147483648).astype(np.float32)
    else:
        raise Unsupported(f"{bits}-bit samples")
    return x.reshape(-1, channels).T


def _chunks(raw: bytes, big: bool) -> Iterator[tuple[bytes, bytes]]:
    """(id, body) from byte 12 on; bodies are padded to even lengths, the last may be cut off."""
    at = 12
    while at + 8 <= len(raw):
        size = int.from_bytes(raw[at + 4 : at + 8], "big" if big else "little")
        yield raw[at : at + 4], raw[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def parse_wav(raw: bytes) -> tuple[int, np.ndarray]:
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise Unsupported("not a RIFF WAVE file")
    form = data = None
    for name, body in _chunks(raw, False):
        if name == b"fmt " and len(body) >= 16:
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if code == 0xFFFE and len(body) >= 26:  # extensible: the code is in the sub-format
                code = struct.unpack("<H", body[24:26])[0]
            form = code, channels, rate, bits
        elif name == b"data":
            data = body
    if form is None or data is None:
        raise Unsupported("no fmt or data chunk")
    code, channels, rate, bits = form
    if code not in (1, 3) or not channels or code == 3 and bits != 32:
        raise Unsupported(f"format {code} with {bits} bits")
    return rate, _pcm(data, bits, False, channels, code == 3)


def extended(raw: bytes) -> float:
    """An 80-bit extended float."""
    exponent, mantissa = struct.unpack(">HQ", raw[:10])
    return (-1.0 if exponent & 0x8000 else 1.0) * mantissa * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63) if mantissa else 0.0


def parse_aiff(raw: bytes) -> tuple[int, np.ndarray]:
    if raw[:4] != b"FORM" or raw[8:12] not in (b"AIFF", b"AIFC"):
        raise Unsupported("not an AIFF file")
    form = data = None
    for name, body in _chunks(raw, True):
        if name == b"COMM":
            channels, _, bits = struct.unpack(">HIH", body[:8])
            form = channels, bits, int(extended(body[8:18]) + 0.5), body[18:22] if raw[8:12] == b"AIFC" else b"NONE"
        elif name == b"SSND":
            data = body[8 + struct.unpack(">I", body[:4])[0] :]
    if form is None or data is None:
        raise Unsupported("no COMM or SSND chunk")
    channels, bits, rate, compression = form
    if compression not in (b"NONE", b"sowt"):
        raise Unsupported(f"compressed AIFF ({compression.decode('latin-1')})")
    if compression == b"sowt" and bits == 8:
        return rate, _pcm(data, 8, True, channels)  # signed in either order
    return rate, _pcm(data, bits, compression == b"NONE", channels)


def encode_wav(channels: list[np.ndarray], rate: int, bits: int = 24, cues: list[int] | None = None) -> bytes:
    """16- or 24-bit PCM; cue points are clamped to the last frame."""
    if bits not in (16, 24):
        raise Unsupported(f"{bits}-bit output")
    x = np.clip(np.asarray(channels, dtype=np.float64), -1, 1).T.reshape(-1)
    n, frames = len(channels), len(channels[0])
    v = np.floor(x * (32767 if bits == 16 else 8388607) + 0.5).astype(np.int32)
    data = v.astype("<i2").tobytes() if bits == 16 else v.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    align = n * bits // 8
    body = b"fmt " + struct.pack("<IHHIIHH", 16, 1, n, rate, rate * align, align, bits) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    if cues:
        points = [min(max(0, int(c)), max(0, frames - 1)) for c in cues]
        body += b"cue " + struct.pack("<II", 4 + 24 * len(points), len(points)) + b"".join(struct.pack("<II4sIII", i + 1, p, b"data", 0, 0, p) for i, p in enumerate(points))
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


#: Decoders of other formats by extension, each from bytes to (sample rate, channels by samples).
DECODERS: dict[str, Callable[[bytes], tuple[int, np.ndarray]]] = {}


def register_decoder(ext: str, decoder: Callable[[bytes], tuple[int, np.ndarray]]) -> None:
    """Files with the extension go to ``decoder``, which must be importable by workers or picklable; ValueError is a bad file."""
    DECODERS[ext.lower()] = decoder


def decode_bytes(raw: bytes, ext: str = "", decoders: dict | None = None) -> tuple[int, np.ndarray]:
    if raw[:4] == b"RIFF":
        return parse_wav(raw)
    if raw[:4] == b"FORM":
        return parse_aiff(raw)
    other = (DECODERS if decoders is None else decoders).get(ext.lower())
    if other:
        return other(raw)
    raise Unsupported(f"no decoder for {ext or 'this format'}")


def decode(files: DataFrame) -> DataFrame:
    """path, sample_rate, channels, error of (path, content)."""

    udf.bounded(files.sparkSession)
    decoders = dict(DECODERS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"]):
                try:
                    rate, x = decode_bytes(bytes(raw), path.rpartition(".")[2], decoders)
                    row = (path, rate, [np.asarray(c, dtype=np.float32) for c in x], None)
                except (ValueError, struct.error) as e:
                    row = (path, None, None, str(e))
                yield pd.DataFrame([row], columns=["path", "sample_rate", "channels", "error"]).astype({"sample_rate": "Int32"})

    return files.select("path", "content").mapInPandas(run, SIGNAL)
