"""Facts that media files tell by their headers: sizes, EXIF, durations, page counts; and PCM sound as windows.

No decoder is needed for these. `facts` reads (path, content) in Arrow batches; a file that can't be read has nulls.
"""

from __future__ import annotations

import io
import re
import struct
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sievework.operators.segment import HOP_S, LEAST_NEW_S, WINDOW_S

RATE = 16_000
#: EXIF tags of orientation, of the block with the date, and of the date a picture was taken.
ORIENTATION, BLOCK, TAKEN = 0x0112, 0x8769, 0x9003
MOST_STREAMS = 4000


def _tags(data: bytes, at: int, order: str) -> Iterator[tuple[int, int, int, bytes]]:
    """Entries of a TIFF directory: tag, kind, count, the four bytes of its value."""
    if at + 2 > len(data):
        return
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) == 12:
            tag, kind, count = struct.unpack(order + "HHI", entry[:8])
            yield tag, kind, count, entry[8:]


def tiff_exif(data: bytes) -> tuple[int | None, str | None]:
    """(orientation, taken) of a TIFF block."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8:
        return None, None
    orientation = taken = None
    todo, seen = [struct.unpack_from(order + "I", data, 4)[0]], set()
    while todo:
        at = todo.pop()
        if at in seen:
            continue
        seen.add(at)
        for tag, kind, count, value in _tags(data, at, order):
            if tag == ORIENTATION and kind == 3:
                orientation = struct.unpack_from(order + "H", value)[0]
            elif tag == BLOCK:
                todo.append(struct.unpack(order + "I", value)[0])
            elif tag == TAKEN and kind == 2 and count >= 19:
                start = struct.unpack(order + "I", value)[0]
                text = data[start : start + 19].decode("ascii", "ignore")
                taken = text if re.fullmatch(r"\d{4}:\d\d:\d\d \d\d:\d\d:\d\d", text) else None
    return (orientation if orientation in range(1, 9) else None), taken


def _jpeg(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Segments of a JPEG up to its pixels."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if mark == 0xDA:
            return
        yield mark, data[at + 4 : at + 2 + size]
        at += 2 + size


def exif(data: bytes) -> tuple[int | None, str | None]:
    """(orientation, taken) of a JPEG, TIFF, WebP or HEIF file."""
    if data[:2] == b"\xff\xd8":
        block = next((s[6:] for m, s in _jpeg(data) if m == 0xE1 and s[:6] == b"Exif\0\0"), b"")
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at = data.find(b"EXIF", 12)
        block = data[at + 8 :].removeprefix(b"Exif\0\0") if at >= 0 else b""
    elif data[4:8] == b"ftyp":
        at = data.find(b"Exif\0\0")
        block = data[at + 6 :] if at >= 0 else b""
    else:
        block = data
    return tiff_exif(block)


def picture_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of a PNG, GIF, BMP, WebP or JPEG."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8":
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM":
        width, height = struct.unpack("<ii", data[18:26])
        return width, abs(height)
    if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8X":
        return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
    if data[:2] == b"\xff\xd8":
        frame = next((s for m, s in _jpeg(data) if 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC)), None)
        return (int.from_bytes(frame[3:5], "big"), int.from_bytes(frame[1:3], "big")) if frame else None
    return None


def duration(data: bytes) -> float | None:
    """Seconds of a WAV or MP4 file, by its header."""
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        with wave.open(io.BytesIO(data)) as w:
            return w.getnframes() / w.getframerate()
    at = data.find(b"mvhd")
    if data[4:8] == b"ftyp" and at >= 0:
        long = data[at + 4] == 1
        scale, length = struct.unpack_from(">IQ" if long else ">II", data, at + (24 if long else 16))
        return length / scale if scale else None
    return None


def page_count(data: bytes) -> int | None:
    """Pages of a PDF: the largest count of its page trees, in its objects and its compressed object streams."""
    if not data.startswith(b"%PDF"):
        return None
    parts = [data]
    for k, m in enumerate(re.finditer(rb"/ObjStm\b[^>]*>>\s*stream\r?\n", data)):
        if k < MOST_STREAMS:
            try:
                parts.append(zlib.decompressobj().decompress(data[m.end() :], 1 << 24))
            except zlib.error:
                continue
    trees = [max(int(n) for n in found) for p in parts if (found := [m[1] or m[2] for m in re.finditer(rb"/Type\s*/Pages\b[^>]*?/Count\s+(\d+)|/Count\s+(\d+)[^>]*?/Type\s*/Pages\b", p)])]
    pages = sum(len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", p)) for p in parts)
    return max(trees) if trees else pages or None


def sound(data: bytes) -> np.ndarray:
    """A WAV file's samples as 16-bit mono at 16 kHz."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = np.frombuffer(w.readframes(w.getnframes()), {1: np.uint8, 2: "<i2", 4: "<i4"}[width])
    level = (raw.astype(float) - 128) * 256 if width == 1 else raw / (1 << 8 * (width - 2))
    mono = level[: len(level) // channels * channels].reshape(-1, channels).mean(1)
    n = int(len(mono) * RATE / rate)
    return np.interp(np.arange(n) * rate / RATE, np.arange(len(mono)), mono).round().astype(np.int16) if len(mono) else np.zeros(0, np.int16)


def windows(samples: np.ndarray, silence: float = 0.003) -> Iterator[tuple[float, float, np.ndarray]]:
    """(start, end, samples) of the windows that aren't silent; a tail only if it brings enough new sound."""
    total, start = len(samples) / RATE, 0.0
    while start == 0 or total - (start + WINDOW_S - HOP_S) >= LEAST_NEW_S:
        part = samples[int(start * RATE) : int((start + WINDOW_S) * RATE)]
        if len(part) and np.sqrt(np.mean((part / 32768.0) ** 2)) > silence:
            yield start, min(start + WINDOW_S, total), part
        start += HOP_S
        if start >= total:
            return


FACTS = "path string, width int, height int, orientation int, taken string, duration double, pages int"


def facts(files: DataFrame) -> DataFrame:
    """(path, content) to what its header tells."""

    def of(content: bytes) -> tuple:
        try:
            size = picture_size(content) or (None, None)
            return (*size, *exif(content), duration(content), page_count(content))
        except (ValueError, struct.error, wave.Error, EOFError, KeyError):
            return (None,) * 6

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *of(bytes(c))) for p, c in zip(frame["path"], frame["content"], strict=True)]
            out = pd.DataFrame(rows, columns=["path", "width", "height", "orientation", "taken", "duration", "pages"])
            yield out.astype({"width": "Int32", "height": "Int32", "orientation": "Int32", "pages": "Int32"})

    return files.select("path", "content").mapInPandas(run, FACTS)
