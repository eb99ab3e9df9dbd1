"""Probing listed files by ranges of bytes: a few kilobytes of a file are read, wherever they lie in it."""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame

from ..schemas import PROBE
from . import raster

#: Bytes of a file's first read; each further read is twice as long as the one before, up to LARGEST.
FIRST, LARGEST = 2_048, 65_536


class Ranges:
    """read(at, n) over a source of ranges: what was fetched is kept, and a miss fetches a window that grows."""

    def __init__(self, fetch: Callable[[int, int], bytes]):
        self.fetch, self.window, self.kept, self.n_bytes = fetch, FIRST, [], 0

    def __call__(self, at: int, n: int) -> bytes:
        for start, data, whole in self.kept:
            if start <= at and (at + n <= start + len(data) or whole):
                return data[at - start : at - start + n]
        want = max(n, self.window)
        data = self.fetch(at, want)
        self.kept.append((at, data, len(data) < want))  # a short answer reaches the file's end
        self.n_bytes += len(data)
        self.window = min(2 * self.window, LARGEST)
        return data[:n]


def _jpeg(read) -> tuple:
    """From segment to segment by their lengths: what a segment holds is read only of EXIF and of the frame."""
    at, turn = 2, None
    while True:
        head = read(at, 4)
        if len(head) < 4:
            raise ValueError("JPEG without a frame header")
        if head[0] != 0xFF:
            raise ValueError("broken JPEG")
        mark, size = head[1], int.from_bytes(head[2:], "big")
        if mark == 0xFF or mark == 0x01 or 0xD0 <= mark <= 0xD7:  # fill bytes, and marks without a length
            at += 1 if mark == 0xFF else 2
            continue
        if mark == 0xE1 and read(at + 4, 6) == b"Exif\0\0":
            turn = raster._exif(read(at + 10, size - 8))
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", read(at + 5, 4))
            return "jpeg", w, h, turn, None
        at += 2 + size


def probe_ranges(read: Callable[[int, int], bytes]) -> tuple:
    """(format, width, height, exif_orientation, error) of a file that read(at, n) gives ranges of."""
    try:
        head = read(0, 32)
        if head[:2] == b"\xff\xd8":
            return _jpeg(read)
        if head[:4] in (b"II*\0", b"MM\0*"):
            at = struct.unpack(("<" if head[:2] == b"II" else ">") + "I", head[4:8])[0]
            return raster.probe(head, read(at, 8192))
        return raster.probe(head)
    except (ValueError, LookupError, struct.error) as e:
        return None, None, None, None, str(e)


def open_ranges(path: str) -> tuple[Callable[[int, int], bytes], Callable[[], None]]:
    """(fetch, close) of a file: mounted ones, or of a file system that Arrow knows by its scheme."""
    if re.match(r"^(?!file:)[a-zA-Z][a-zA-Z0-9+.-]+://", path):
        scheme, rest = path.split("://", 1)
        host, _, name = rest.partition("/")
        system, root = pyarrow.fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{host}/")
        file = system.open_input_file(f"{root.rstrip('/')}/{name}")
        return lambda at, n: file.read_at(n, at), file.close
    handle = os.open(re.sub(r"^file:/+", "/", path), os.O_RDONLY)

    def fetch(at: int, n: int) -> bytes:
        return os.pread(handle, n, at)

    return fetch, lambda: os.close(handle)


def probe_paths(files: DataFrame) -> DataFrame:
    """Adds format, width, height, exif_orientation, probe_error and probe_bytes (bytes read) to a listing with ``path``.

    Content is never a column: each task opens its files and reads ranges of them. A file that can't be read has an
    error row. A listing of few partitions should be repartitioned by path before, as each task reads its own files.
    """
    new = [*PROBE.fieldNames(), "probe_bytes"]
    keep = [c for c in files.columns if c not in new]
    where = keep.index("path")
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64())

    def one(path: str | None) -> tuple:
        try:
            fetch, close = open_ranges(path or "")
        except (OSError, ValueError) as e:
            return None, None, None, None, f"can't be read: {e}"[:200], 0
        try:
            read = Ranges(fetch)
            return (*probe_ranges(read), read.n_bytes)
        except OSError as e:
            return None, None, None, None, f"can't be read: {e}"[:200], 0
        finally:
            close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(p) for p in b.column(where).to_pylist()]
            added = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*keep, *new])

    listing = files.select(*keep)
    schema = type(listing.schema)([*listing.schema.fields, *PROBE.fields]).add("probe_bytes", "long")
    return listing.mapInArrow(run, schema)


#: Bytes of a file's head for file_digests, and of each read of a whole file.
HEAD, READ = 4_096, 1 << 20


def file_digests(files: DataFrame, part: str = "full") -> DataFrame:
    """Adds digest (SHA-256, lowercase hex) of each listed file's first HEAD bytes ("head") or of all ("full"); null if it can't be read.

    Whole files are read in pieces of READ bytes, so no task holds one.
    """
    keep = [c for c in files.columns if c != "digest"]
    where = keep.index("path")

    def one(path: str | None) -> str | None:
        digest = hashlib.sha256()
        try:
            fetch, close = open_ranges(path or "")
        except (OSError, ValueError):
            return None
        try:
            if part == "head":
                digest.update(fetch(0, HEAD))
                return digest.hexdigest()
            at = 0
            while data := fetch(at, READ):
                digest.update(data)
                at += len(data)
            return digest.hexdigest()
        except OSError:
            return None
        finally:
            close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([one(p) for p in b.column(where).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*keep, "digest"])

    listing = files.select(*keep)
    return listing.mapInArrow(run, type(listing.schema)([*listing.schema.fields]).add("digest", "string"))
