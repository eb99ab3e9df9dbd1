"""Small vectorised helpers on picture bytes: header probe, PNG and BMP pixels, crops.

JPEG, PNG, BMP, GIF, WebP and TIFF headers are read (of JPEG the first HEADER_BYTES); pixels only of PNG (8 bits, not
interlaced) and BMP (24 or 32 bits, not compressed). Anything else is an error value.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import PROBE

HEADER_BYTES = 262_144


def _exif(data: bytes) -> int | None:
    """Orientation of an EXIF block (behind its Exif mark), if it has one."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order:
        return None
    at = struct.unpack_from(order + "I", data, 4)[0]
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, _, value = struct.unpack_from(order + "HHIH", data, at + 2 + 12 * k)
        if tag == 0x0112 and kind == 3:
            return value if 1 <= value <= 8 else None
    return None


def _jpeg(data: bytes):
    at, turn = 2, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("broken JPEG")
        mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            turn = _exif(data[at + 10 : at + 2 + size])
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", data, at + 5)
            return "jpeg", w, h, turn
        at += 2 + size
    raise ValueError("JPEG without a frame header")


def _webp(data: bytes):
    kind = data[12:16]
    if kind == b"VP8X":
        return "webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"), None
    if kind == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        return "webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), None
    w, h = struct.unpack_from("<HH", data, 26)
    return "webp", w & 0x3FFF, h & 0x3FFF, None


def _tiff(data: bytes, directory: bytes):
    """From the first image's directory, which may lie anywhere in the file."""
    order, found = {b"II": "<", b"MM": ">"}[data[:2]], {}
    for k in range(struct.unpack_from(order + "H", directory)[0]):
        tag, kind = struct.unpack_from(order + "HH", directory, 2 + 12 * k)
        if tag in (256, 257, 274):
            found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), directory, 10 + 12 * k)[0]
    turn = found.get(274)
    return "tiff", found[256], found[257], turn if turn in range(1, 9) else None


def probe(data: bytes | None, directory: bytes | None = None) -> tuple:
    """(format, width, height, exif_orientation, error) from a file's first bytes, and of a TIFF file its directory."""
    try:
        if not data:
            raise ValueError("empty file")
        if data[:2] == b"\xff\xd8":
            return (*_jpeg(data), None)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return ("png", *struct.unpack_from(">II", data, 16), None, None)
        if data[:2] == b"BM":
            w, h = struct.unpack_from("<ii", data, 18)
            return ("bmp", w, abs(h), None, None)
        if data[:4] == b"GIF8":
            return ("gif", *struct.unpack_from("<HH", data, 6), None, None)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return (*_webp(data), None)
        if data[:4] in (b"II*\0", b"MM\0*"):
            return (*_tiff(data, directory or b""), None)
        raise ValueError("no known picture format")
    except (ValueError, LookupError, struct.error) as e:
        return None, None, None, None, str(e)


def probe_images(files: DataFrame) -> DataFrame:
    """Adds format, width, height, exif_orientation and probe_error of ``content``, which is dropped."""
    keep = [c for c in files.columns if c != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [probe(x.as_py(), y.as_py()) for x, y in zip(b.column(len(keep)), b.column(len(keep) + 1), strict=True)]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *new], names=[*keep, *PROBE.fieldNames()])

    content, at = F.col("content"), F.hex(F.substring("content", 5, 4))
    little = F.concat(*(F.substring(at, k, 2) for k in (7, 5, 3, 1)))
    kind = F.hex(F.substring("content", 1, 4))
    place = F.conv(F.when(kind == "49492A00", little).when(kind == "4D4D002A", at), 16, 10).cast("long")
    directory = F.when((place > 0) & (place < F.length(content)), content.substr((place + 1).cast("int"), F.lit(8192)))
    head = files.select(*keep, F.substring("content", 1, HEADER_BYTES).alias("content"), directory.alias("_directory"))
    schema = type(files.schema)([*files.select(*keep).schema.fields, *PROBE.fields])
    return head.mapInArrow(run, schema)


def to_png(pixels: np.ndarray) -> bytes:
    """PNG of an array (h, w) or (h, w, 3) of bytes."""
    h, w = pixels.shape[:2]
    rows = np.zeros((h, 1 + w * (pixels.size // (h * w))), np.uint8)
    rows[:, 1:] = pixels.reshape(h, -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def unfilter(raw: bytes, h: int, stride: int, step: int) -> np.ndarray:
    """Rows of PNG-filtered bytes (h rows of a filter byte and stride bytes)."""
    rows = np.frombuffer(raw, np.uint8, h * (stride + 1)).reshape(h, stride + 1)
    out, above = np.zeros((h, stride), np.uint8), np.zeros(stride, np.uint8)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = line + above
        elif kind == 1:
            for c in range(step):
                out[y, c::step] = np.cumsum(line[c::step], dtype=np.uint8)
        else:
            for x in range(stride):
                a = int(out[y, x - step]) if x >= step else 0
                b, c = int(above[x]), int(above[x - step]) if x >= step else 0
                p = a + b - c
                near = (a + b) // 2 if kind == 3 else min((abs(p - v), k, v) for k, v in enumerate((a, b, c)))[2]
                out[y, x] = (int(line[x]) + near) & 255
        above = out[y]
    return out


def png_parts(data: bytes) -> tuple[int, int, int, bytes]:
    """(width, height, channels, deflated rows) of an 8-bit PNG that is not interlaced and has no palette."""
    at, body, head = 8, [], None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        head = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head
        body += [part] if kind == b"IDAT" else []
        at += 12 + n
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 4, 6):
        raise ValueError("PNG of a kind that is not supported")
    return head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]], b"".join(body)


def pixels_of(data: bytes) -> np.ndarray:
    """Pixels (h, w) or (h, w, 3) of a PNG or BMP; alpha is dropped."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        w, h, n, body = png_parts(data)
        out = unfilter(zlib.decompress(body), h, w * n, n).reshape(h, w, n)
        return out[:, :, 0] if n < 3 else out[:, :, :3]
    if data[:2] == b"BM":
        start, (w, h), (bits, packed) = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<ii", data, 18), struct.unpack_from("<HI", data, 28)
        if bits not in (24, 32) or packed:
            raise ValueError("BMP of a kind that is not supported")
        stride = (w * bits // 8 + 3) // 4 * 4
        out = np.frombuffer(data, np.uint8, abs(h) * stride, start).reshape(abs(h), stride)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
        return (out[::-1] if h > 0 else out)[:, :, 2::-1]
    raise ValueError("pixels of this format can't be read here")


def turn(pixels: np.ndarray, angle: int) -> np.ndarray:
    """Turned clockwise by a multiple of 90 degrees."""
    return np.rot90(pixels, -(angle // 90) % 4)


def shrink(pixels: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means of blocks; h and w must divide the size."""
    parts = pixels.reshape(h, pixels.shape[0] // h, w, pixels.shape[1] // w, *pixels.shape[2:])
    return parts.mean(axis=(1, 3)).round().astype(np.uint8)


def grid_boxes(h: int, w: int, rows: int, cols: int) -> list[tuple[int, int, int, int]]:
    """(top, left, bottom, right) of each part of a grid, row by row."""
    y, x = [h * k // rows for k in range(rows + 1)], [w * k // cols for k in range(cols + 1)]
    return [(y[r], x[c], y[r + 1], x[c + 1]) for r in range(rows) for c in range(cols)]


def gutter_boxes(pixels: np.ndarray, white: int = 255) -> list[tuple[int, int, int, int]]:
    """Boxes between rows and columns that are white throughout."""
    ink = (pixels < white).any(axis=2) if pixels.ndim == 3 else pixels < white

    def spans(used: np.ndarray) -> list[tuple[int, int]]:
        edge = np.flatnonzero(np.diff(np.r_[False, used, False].astype(np.int8)))
        return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]

    return [(t, le, b, r) for t, b in spans(ink.any(axis=1)) for le, r in spans(ink[t:b].any(axis=0))]
