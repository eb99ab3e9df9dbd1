"""PDF export, re-import and splitting as Spark jobs.

Pages are made in parallel, each from at most 16 photos; an album's file is then written
page by page in one task, in constant memory. Pictures are never decoded for that: JPEG
data goes in as it is, PNG data with its own predictor, and turns are placement matrices.
The edit state is a JSON stream that the catalog names; re-import gives it back. Whether
originals are still there is for the caller to ask (operators.photos.resolve_originals).
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import A4_HEIGHT_MM, A4_WIDTH_MM, POINTS_PER_MM
from ..functions.paths import normalize_path
from ..operators.manifests import pack_manifest, unpack_manifest
from ..schemas import EXTRACTED, PDFS
from .raster import gutter_boxes, grid_boxes, pixels_of, png_parts, probe, to_png, unfilter

STATE_KEY = "SheetwrightState"
#: Pages of a file; a longer album has more volumes.
VOLUME = 2_000
_PAGE = "album_id bigint, page_no int, n_photos int, n_undrawn int, dicts array<string>, streams array<binary>"
_WIDTH, _HEIGHT = A4_WIDTH_MM * POINTS_PER_MM, A4_HEIGHT_MM * POINTS_PER_MM


# Writing


def image_object(data: bytes) -> tuple[str, bytes]:
    """Dictionary entries and stream of a picture, without decoding where the format allows."""
    kind, w, h, _, error = probe(data)
    if error:
        raise ValueError(error)
    entries = f"/Type /XObject /Subtype /Image /Width {w} /Height {h} /BitsPerComponent 8"
    if kind == "jpeg":
        at = data.index(b"\xff", 2)
        while not (0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC)):
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        space = {1: "/DeviceGray", 3: "/DeviceRGB", 4: "/DeviceCMYK"}[data[at + 9]]
        return f"{entries} /ColorSpace {space} /Filter /DCTDecode", data
    if kind == "png":
        w, h, n, body = png_parts(data)
        if n in (1, 3):
            space = "/DeviceGray" if n == 1 else "/DeviceRGB"
            parms = f"/DecodeParms << /Predictor 15 /Colors {n} /BitsPerComponent 8 /Columns {w} >>"
            return f"{entries} /ColorSpace {space} /Filter /FlateDecode {parms}", body
    pixels = pixels_of(data)
    space = "/DeviceRGB" if pixels.ndim == 3 else "/DeviceGray"
    return f"{entries} /ColorSpace {space} /Filter /FlateDecode", zlib.compress(np.ascontiguousarray(pixels).tobytes())


def placement(turn: int, mirror: bool, x: float, y: float, w: float, h: float) -> str:
    """Matrix that draws the unit picture, mirrored and turned clockwise, in a box given from the page's top left."""
    corner = {0: (1, 0, 0, 1, 0, 0), 90: (0, -1, 1, 0, 0, 1), 180: (-1, 0, 0, -1, 1, 1), 270: (0, 1, -1, 0, 1, 0)}[turn]
    a, b, c, d, e, f = corner
    if mirror:
        a, b, e, f = -a, -b, e + a, f + b
    m = (a * w, b * h, c * w, d * h, x + e * w, _HEIGHT - y - h + f * h)
    return " ".join(f"{v:.4f}" for v in m)


def _page(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One page: objects whose references {k} count from the page's first object."""
    dicts, streams, draw, names = [], [], [], []
    for r in rows.sort_values("slot").itertuples():
        try:
            entries, data = image_object(bytes(r.content))
        except (TypeError, ValueError, KeyError, IndexError, zlib.error):
            continue  # the cell stays blank and is counted in n_undrawn; the probe has told why
        names.append(f"/P{len(names)} {{{len(dicts)}}} 0 R")
        draw.append(f"q {placement(int(r.turn), bool(r.mirror), r.draw_x, r.draw_y, r.draw_w, r.draw_h)} cm /P{len(names) - 1} Do Q")
        dicts.append(entries)
        streams.append(data)
    dicts.append("")
    streams.append("\n".join(draw).encode())
    dicts.append(f"/Type /Page /Parent {{parent}} 0 R /MediaBox [0 0 {_WIDTH:.2f} {_HEIGHT:.2f}] /Contents {{{len(dicts) - 1}}} 0 R /Resources << /XObject << {' '.join(names)} >> >>")
    streams.append(None)
    return pd.DataFrame([{"album_id": key[0], "page_no": key[1], "n_photos": len(names), "n_undrawn": len(rows) - len(names), "dicts": dicts, "streams": streams}])


def render_pages(cells: DataFrame, photos: DataFrame) -> DataFrame:
    """Page objects by (album_id, page_no). cells: placed cells; photos: norm_path, content; joined late."""
    one = photos.select("norm_path", "content").dropDuplicates(["norm_path"])
    rows = cells.select("album_id", "page_no", "slot", "norm_path", "turn", "mirror", "draw_x", "draw_y", "draw_w", "draw_h")
    return rows.join(one, "norm_path", "left").groupBy("album_id", "page_no").applyInPandas(_page, _PAGE)


class _File:
    """A PDF that is written object by object; the first two numbers are the catalog and the page tree."""

    def __init__(self, path: str):
        self.path, self.temp = path, f"{path}.{os.getpid()}.part"
        self.out, self.at, self.offsets, self.kids, self.photos, self.undrawn, self.state = open(self.temp, "wb"), 0, {}, [], 0, 0, None  # noqa: SIM115
        self._put(b"%PDF-1.5\n")

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, number: int, entries: str, stream: bytes | None) -> None:
        self.offsets[number] = self.at
        self._put(f"{number} 0 obj\n<< {entries}".encode())
        if stream is None:
            self._put(b" >>\nendobj\n")
        else:
            self._put(f" /Length {len(stream)} >>\nstream\n".encode() + stream + b"\nendstream\nendobj\n")

    def page(self, dicts, streams, n: int, undrawn: int) -> None:
        first = len(self.offsets) + 3
        number = lambda m: str(2 if m[1] == "parent" else first + int(m[1]))
        for k, (d, s) in enumerate(zip(dicts, streams, strict=True)):
            self.add(first + k, re.sub(r"\{(\w+)\}", number, d), s)
        self.kids.append(first + len(dicts) - 1)
        self.photos += n
        self.undrawn += undrawn

    def close(self) -> int:
        """Write the tail and give the file its name; a failed task leaves no file of that name."""
        extra = ""
        if self.state is not None:
            n = len(self.offsets) + 3
            self.add(n, "/Filter /FlateDecode", zlib.compress(self.state.encode()))
            extra = f" /{STATE_KEY} {n} 0 R"
        self.add(1, f"/Type /Catalog /Pages 2 0 R{extra}", None)
        self.add(2, f"/Type /Pages /Count {len(self.kids)} /Kids [{' '.join(f'{k} 0 R' for k in self.kids)}]", None)
        start, n = self.at, len(self.offsets) + 1
        self._put(f"xref\n0 {n}\n0000000000 65535 f \n".encode())
        for k in range(1, n):
            self._put(f"{self.offsets[k]:010d} 00000 n \n".encode())
        self._put(f"trailer\n<< /Size {n} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode())
        self.out.close()
        os.replace(self.temp, self.path)
        return self.at


def mounted(folder: str) -> str:
    """The path of a folder that all executors mount; folders of other file systems are refused, as tasks would write beside them."""
    if re.match(r"^(?!file:)[a-zA-Z][a-zA-Z0-9+.-]+:/", folder):
        raise ValueError(f"{folder} isn't a mounted folder")
    return re.sub(r"^file:/+", "/", folder)


def export_pdf(cells: DataFrame, photos: DataFrame, out: str) -> DataFrame:
    """Write the albums as PDFs to the folder out (mounted on all executors); returns the table ``pdfs``.

    A file is a volume of VOLUME pages with the state of its own photos, so no task or row
    grows with its album: album-<id>.pdf, album-<id>-1.pdf and so on. Written when the result
    is computed. A file is renamed into place once whole, so a task that runs again replaces it.
    """
    volume = F.floor(F.col("page_no") / VOLUME).cast("int")
    states = pack_manifest(cells, volume).select("album_id", (F.col("block") * VOLUME).alias("page_no"), "state")
    pages = render_pages(cells, photos).join(states, ["album_id", "page_no"], "left").withColumn("volume", volume)
    pages = pages.repartition("album_id", "volume").sortWithinPartitions("album_id", "volume", "page_no")
    folder = mounted(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        album, pdf = None, None

        def done():
            size = pdf.close()
            values = ([album[0]], [album[1]], [len(pdf.kids)], [pdf.photos], [pdf.undrawn], [size], [pdf.path])
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], PDFS.fieldNames())

        for b in batches:
            for k in range(b.num_rows):
                r = {n: b.column(n)[k].as_py() for n in b.schema.names}
                if pdf is None or (r["album_id"], r["volume"]) != album:
                    if pdf is not None:
                        yield done()
                    album = r["album_id"], r["volume"]
                    pdf = _File(f"{folder}/album-{album[0]}{f'-{album[1]}' if album[1] else ''}.pdf")
                pdf.state = r["state"] if r["state"] is not None else pdf.state
                pdf.page(r["dicts"], r["streams"], r["n_photos"], r["n_undrawn"])
        if pdf is not None:
            yield done()

    return pages.mapInArrow(run, PDFS)


# Reading


class _Reader:
    """Objects of a PDF found by their marks, those in object streams too; enough for pictures and our state."""

    def __init__(self, data: bytes):
        if data[:5] != b"%PDF-":
            raise ValueError("not a PDF")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("encrypted")
        self.objects: dict[int, tuple[bytes, bytes | None]] = {}
        at = 0
        while m := re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b").search(data, at):
            end = re.compile(rb"\bstream\r?\n|\bendobj\b").search(data, m.end())
            if not end:
                break
            head, stream, at = data[m.end() : end.start()], None, end.end()
            if end[0].startswith(b"stream"):
                size = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
                to = at + int(size[1]) if size else -1
                if to < 0 or not re.match(rb"\s*endstream", data[to : to + 20]):
                    to = data.find(b"endstream", at)
                    if to < 0:
                        break
                    to -= data[to - 2 : to] == b"\r\n" and 2 or data[to - 1 : to] in (b"\n", b"\r") and 1 or 0
                stream, at = data[at:to], to
            self.objects[int(m[1])] = (head, stream)
        for head, stream in list(self.objects.values()):
            if stream is not None and re.search(rb"/Type\s*/ObjStm", head):
                body, n, first = self.inflated(head, stream), self.number(head, "N"), self.number(head, "First")
                marks = list(map(int, body[:first].split()))[: 2 * n]
                for k in range(n):
                    to = first + marks[2 * k + 3] if k + 1 < n else len(body)
                    self.objects.setdefault(marks[2 * k], (body[first + marks[2 * k + 1] : to], None))

    def number(self, head: bytes, name: str, default: int | None = None) -> int:
        m = re.search(rb"/%s\s+(\d+)(\s+\d+\s+R)?" % name.encode(), head)
        if m is None:
            if default is None:
                raise ValueError(f"no {name}")
            return default
        return int(self.objects[int(m[1])][0].split()[0]) if m[2] else int(m[1])

    def inflated(self, head: bytes, stream: bytes) -> bytes:
        """The stream's bytes, through FlateDecode and its predictor."""
        filters = re.findall(rb"/(\w+Decode)\b", re.sub(rb"/DecodeParms.*", b"", head, flags=re.S)) or re.findall(rb"/Filter\s*/(\w+)", head)
        if not filters:
            return stream
        if filters != [b"FlateDecode"]:
            raise ValueError(f"filter {b' '.join(filters).decode()} is not supported")
        raw = zlib.decompress(stream)
        if self.number(head, "Predictor", 1) >= 10:
            columns, colors = self.number(head, "Columns", 1), self.number(head, "Colors", 1)
            raw = unfilter(raw, len(raw) // (columns * colors + 1), columns * colors, colors).tobytes()
        return raw

    def state(self) -> str | None:
        """The JSON text of our state, the last if there are several."""
        found = None
        for head, _ in self.objects.values():
            if m := re.search(rb"/%s\s+(\d+)\s+\d+\s+R" % STATE_KEY.encode(), head):
                found = self.inflated(*self.objects[int(m[1])]).decode()
        return found

    def pages(self) -> list[int]:
        """Numbers of the page objects in reading order."""
        roots = [n for n, (h, _) in self.objects.items() if re.search(rb"/Type\s*/Pages\b", h) and not re.search(rb"/Parent\b", h)]
        order, todo, seen = [], roots[::-1], set()
        while todo:
            n = todo.pop()
            if n in seen or n not in self.objects:
                continue
            seen.add(n)
            head = self.objects[n][0]
            if re.search(rb"/Type\s*/Pages\b", head):
                kids = re.search(rb"/Kids\s*\[([^\]]*)\]", head)
                todo += [int(k) for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1] if kids else b"")][::-1]
            else:
                order.append(n)
        return order or sorted(n for n, (h, _) in self.objects.items() if re.search(rb"/Type\s*/Page\b", h))

    def images(self, page: int) -> list[int]:
        """Numbers of the pictures that a page's resources name, in the order of its resources."""
        head = self.objects[page][0]
        for key in (b"Resources", b"XObject"):
            if m := re.search(rb"/%s\s+(\d+)\s+\d+\s+R" % key, head):
                head += self.objects.get(int(m[1]), (b"", None))[0]
        inside = re.search(rb"/XObject\s*<<(.*?)>>", head, re.S)
        refs = re.findall(rb"/\S+\s+(\d+)\s+\d+\s+R", inside[1] if inside else head)
        return [n for n in dict.fromkeys(map(int, refs)) if re.search(rb"/Subtype\s*/Image\b", self.objects.get(n, (b"", None))[0])]

    def image(self, n: int) -> tuple[str, int, int, bytes]:
        """(format, width, height, file bytes) of a picture: JPEG as it is, others as PNG."""
        head, stream = self.objects[n]
        w, h = self.number(head, "Width"), self.number(head, "Height")
        if re.search(rb"/Filter\s*\[?\s*/DCTDecode", head):
            return "jpeg", w, h, stream
        raw = self.inflated(head, stream)
        if self.number(head, "BitsPerComponent", 8) != 8 or len(raw) not in (w * h, w * h * 3):
            raise ValueError("pixels of a kind that is not supported")
        pixels = np.frombuffer(raw, np.uint8)
        return "png", w, h, to_png(pixels.reshape(h, w) if len(raw) == w * h else pixels.reshape(h, w, 3))


def read_states(pdfs: DataFrame) -> DataFrame:
    """path, own (whether the PDF is one of ours), state (JSON) and error of each PDF (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    state = _Reader(data.as_py() or b"").state()
                    json.loads(state or "null")
                    rows.append((path, state is not None, state, None))
                except (ValueError, KeyError, IndexError, zlib.error) as e:
                    rows.append((path, False, None, str(e)))
            kinds = (pa.string(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["path", "own", "state", "error"])

    return pdfs.select("path", "content").mapInArrow(run, "path string, own boolean, state string, error string")


def is_own_pdf(pdfs: DataFrame) -> DataFrame:
    """path, own."""
    return read_states(pdfs).select("path", "own")


def import_own_pdf(pdfs: DataFrame) -> DataFrame:
    """album_id, path, pos, rotation, layout of each photo in our PDFs (path, content)."""
    return unpack_manifest(read_states(pdfs).filter("own"))


def extract_pdf_images(pdfs: DataFrame) -> DataFrame:
    """A row for each picture of each page; a PDF or picture that can't be read gives a row with ``error``."""
    names = EXTRACTED.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                try:
                    reader = _Reader(data.as_py() or b"")
                    for page, number in enumerate(reader.pages()):
                        for k, n in enumerate(reader.images(page=number)):
                            try:
                                rows.append((path, page, k, None, *reader.image(n), None))
                            except (ValueError, KeyError, IndexError, zlib.error) as e:
                                rows.append((path, page, k, None, None, None, None, None, str(e)))
                except (ValueError, KeyError, IndexError, zlib.error) as e:
                    rows.append((path, None, None, None, None, None, None, None, str(e)))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return pdfs.select("path", "content").mapInArrow(run, EXTRACTED)


def _split(images: DataFrame, boxes) -> DataFrame:
    """Each picture cut into boxes(pixels): EXTRACTED rows with src_part counting the parts of the picture."""
    names = EXTRACTED.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows = []
                try:
                    if r["error"]:
                        raise ValueError(r["error"])
                    pixels = pixels_of(r["content"])
                    for k, (top, left, bottom, right) in enumerate(boxes(pixels)):
                        part = np.ascontiguousarray(pixels[top:bottom, left:right])
                        rows.append((r["src_pdf"], r["src_page"], r["src_index"], k, "png", right - left, bottom - top, to_png(part), None))
                except (ValueError, zlib.error) as e:
                    rows.append((r["src_pdf"], r["src_page"], r["src_index"], None, r["format"], r["width"], r["height"], None, str(e)))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], names)

    return images.select(*names).mapInArrow(run, EXTRACTED)


def split_page_whole(images: DataFrame) -> DataFrame:
    """One photo a page: its largest picture (scans)."""
    best = F.row_number().over(_by_page().orderBy(F.desc(F.col("width").cast("long") * F.col("height")), "src_index"))
    return images.withColumn("_nth", best).filter("_nth = 1").drop("_nth")


def _by_page():
    from pyspark.sql import Window

    return Window.partitionBy("src_pdf", "src_page")


def split_page_grid(images: DataFrame, rows: int, cols: int) -> DataFrame:
    """Each picture cut into a grid (photo sheets)."""
    return _split(images, lambda p: grid_boxes(*p.shape[:2], rows, cols))


def split_page_gutters(images: DataFrame, white: int = 255) -> DataFrame:
    """Each picture cut at rows and columns that are white throughout."""
    return _split(images, lambda p: gutter_boxes(p, white))


def import_foreign_pdf(pdfs: DataFrame, split: str = "extract", rows: int = 3, cols: int = 3, windows: bool = False) -> DataFrame:
    """Photos of PDFs by other software, with norm_path as their own identity: <pdf>#p<page>i<index>, and k<part> if split.

    <pdf> is the PDF's normalised path, so that one PDF in two spellings gives its photos once. split: extract, whole, grid or gutters. These are ours; the tool's four ways are not described.
    """
    images = extract_pdf_images(pdfs)
    if split == "whole":
        images = split_page_whole(images)
    elif split == "grid":
        images = split_page_grid(images, rows, cols)
    elif split == "gutters":
        images = split_page_gutters(images)
    elif split != "extract":
        raise ValueError(f"no way to split called {split}")
    name = F.format_string("%s#p%di%d", normalize_path(F.col("src_pdf"), windows=windows), F.col("src_page"), F.col("src_index"))
    part = F.when(F.col("src_part").isNull(), "").otherwise(F.concat(F.lit("k"), F.col("src_part")))
    return images.withColumn("norm_path", F.concat(name, part))
