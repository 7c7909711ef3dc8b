"""Headers built here: EXIF, sizes, durations, page counts, windows of sound."""

import io
import struct
import wave
import zlib

import numpy as np
from sievework.sources import media_files as M


def tiff(order="<"):
    mark, e = (b"II", "<") if order == "<" else (b"MM", ">")
    head = mark + struct.pack(e + "HI", 42, 8)
    first = struct.pack(e + "H", 2) + struct.pack(e + "HHIHH", 0x0112, 3, 1, 6, 0) + struct.pack(e + "HHII", 0x8769, 4, 1, 38) + struct.pack(e + "I", 0)
    block = struct.pack(e + "H", 1) + struct.pack(e + "HHII", 0x9003, 2, 20, 56) + struct.pack(e + "I", 0)
    return head + first + block + b"2024:05:06 07:08:09\0"


def jpeg():
    app = b"Exif\0\0" + tiff()
    frame = struct.pack(">BHHB", 8, 480, 640, 3) + b"\0" * 9
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc0" + struct.pack(">H", len(frame) + 2) + frame + b"\xff\xda\0\2"


def wav(seconds, rate=8000, level=8000, channels=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        tone = (np.sin(np.arange(int(seconds * rate)) / 5) * level).astype("<i2")
        w.writeframes(np.repeat(tone, channels).tobytes())
    return out.getvalue()


def test_exif_and_sizes():
    assert M.exif(jpeg()) == M.exif(tiff()) == M.exif(tiff(">")) == (6, "2024:05:06 07:08:09")
    assert M.exif(b"RIFF____WEBPVP8X" + b"\0" * 20 + b"EXIF____" + tiff()) == (6, "2024:05:06 07:08:09")
    assert M.exif(b"\0\0\0\x18ftypheic" + b"\0" * 9 + b"Exif\0\0" + tiff()) == (6, "2024:05:06 07:08:09")
    assert M.exif(b"II*\0") == (None, None) and M.exif(b"plain") == (None, None)
    assert M.picture_size(jpeg()) == (640, 480) and M.picture_size(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4)
    assert M.picture_size(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 7, 9)) == (7, 9)


def test_durations_and_pages():
    assert M.duration(wav(2)) == 2.0
    assert M.duration(b"\0\0\0\x18ftypisom" + b"mvhd" + b"\0" * 12 + struct.pack(">II", 1000, 90_500)) == 90.5
    assert M.page_count(b"%PDF-1.4 << /Type /Pages /Kids [] /Count 12 >> << /Type /Page >>") == 12
    packed = zlib.compress(b"<< /Count 5 /Type /Pages >>")
    assert M.page_count(b"%PDF-1.5 1 0 obj << /Type /ObjStm /N 1 >>\nstream\n" + packed + b"\nendstream") == 5
    assert M.page_count(b"no pdf") is None


def test_windows_of_sound():
    samples = M.sound(wav(61))
    assert abs(len(samples) - 61 * 16_000) <= 1
    assert [(a, b) for a, b, _ in M.windows(samples)] == [(0.0, 30.0), (25.0, 55.0), (50.0, 61.0)]
    assert [(a, b) for a, b, _ in M.windows(M.sound(wav(31)))] == [(0.0, 30.0)]
    assert list(M.windows(M.sound(wav(5, level=0)))) == [] and len(list(M.windows(M.sound(wav(3))))) == 1


def test_facts(spark):
    rows = [("/a.jpg", bytearray(jpeg())), ("/b.wav", bytearray(wav(3))), ("/c.png", bytearray(b"\x89PNG\r\n\x1a\n")), ("/d", bytearray(b""))]
    got = {r["path"]: tuple(r)[1:] for r in M.facts(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["/a.jpg"][:4] == (640, 480, 6, "2024:05:06 07:08:09") and got["/b.wav"][4] == 3.0
    assert got["/c.png"] == got["/d"] == (None,) * 6
