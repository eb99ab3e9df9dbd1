import os
import struct
import zlib

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from sheetwright.operators import photos
from sheetwright.operators.pages import paginate, place
from sheetwright.sources import pdf, raster, scan
from sheetwright.streaming.watch import watch_folder


def jpeg(w, h, orientation=None):
    """A JPEG header: EXIF where given, then a frame; enough for a probe."""
    exif = b""
    if orientation:
        body = b"Exif\0\0MM\0*\0\0\0\x08\0\x01" + struct.pack(">HHIHH", 0x0112, 3, 1, orientation, 0) + b"\0\0\0\0"
        exif = b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + exif + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\x01\x11\0\xff\xd9"


def bmp(pixels):
    h, w = pixels.shape[:2]
    rows_ = [r.tobytes() + b"\0" * (-len(r.tobytes()) % 4) for r in pixels[::-1, :, ::-1]]
    return b"BM" + struct.pack("<IHHI", 54, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, 0, 0, 0, 0, 0) + b"".join(rows_)


PIXELS = np.arange(72, dtype=np.uint8).reshape(4, 6, 3) * 3


def test_probe():
    assert raster.probe(jpeg(40, 30, 6)) == ("jpeg", 40, 30, 6, None)
    assert [raster.probe(jpeg(4, 3, k))[3] for k in range(1, 9)] == list(range(1, 9))
    assert raster.probe(raster.to_png(PIXELS))[:3] == ("png", 6, 4)
    assert raster.probe(bmp(PIXELS))[:3] == ("bmp", 6, 4)
    assert raster.probe(b"GIF89a" + struct.pack("<HH", 7, 5))[:3] == ("gif", 7, 5)
    for order, mark in (("<", b"II*\0"), (">", b"MM\0*")):
        entries = b"".join(struct.pack(order + "HHI", t, 3, 1) + struct.pack(order + "HH", v, 0) for t, v in ((256, 70), (257, 50), (274, 8)))
        directory = struct.pack(order + "H", 3) + entries
        assert raster.probe(mark + struct.pack(order + "I", 8), directory) == ("tiff", 70, 50, 8, None)
    for bad in (b"II*\0", b"", None, b"text", b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n"):
        assert raster.probe(bad)[4]


def test_tiff_directory_at_the_end_of_a_long_file(spark):
    far = 400_000
    entries = b"".join(struct.pack("<HHI", t, 4, 1) + struct.pack("<I", v) for t, v in ((256, 700), (257, 500)))
    data = b"II*\0" + struct.pack("<I", far) + b"\0" * (far - 8) + struct.pack("<H", 2) + entries
    files = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"II*\0\xff\xff\xff\x7f")), (3, None)], "k int, content binary")
    got = {r["k"]: (r["format"], r["width"], r["height"], r["probe_error"] is None) for r in raster.probe_images(files).collect()}
    assert got == {1: ("tiff", 700, 500, True), 2: (None, None, None, False), 3: (None, None, None, False)}


def test_pixels_and_turns():
    assert (raster.pixels_of(raster.to_png(PIXELS)) == PIXELS).all() and (raster.pixels_of(bmp(PIXELS)) == PIXELS).all()
    p = PIXELS
    for _ in range(4):
        p = raster.turn(p, 90)
    assert (p == PIXELS).all() and (raster.turn(PIXELS, 90)[0, 0] == PIXELS[-1, 0]).all()


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    flat = PIXELS.reshape(4, 18).astype(int)
    out = b""
    for y in range(4):
        a = np.r_[[0] * 3, flat[y, :-3]]
        b = flat[y - 1] if y else np.zeros(18, int)
        c = np.r_[[0] * 3, b[:-3]]
        near = [min((abs(v), k, u) for k, (v, u) in enumerate(((bb - cc, aa), (aa - cc, bb), (aa + bb - 2 * cc, cc))))[2] for aa, bb, cc in zip(a, b, c, strict=True)]
        out += bytes([kind]) + ((flat[y] - [0 * a, a, b, (a + b) // 2, np.array(near)][kind]) % 256).astype(np.uint8).tobytes()
    assert (raster.unfilter(out, 4, 18, 3) == PIXELS.reshape(4, 18)).all()


def test_placement_matrices():
    """The corners of the unit picture land in the box for all turns, mirrored or not."""
    for turn in (0, 90, 180, 270):
        for mirror in (False, True):
            a, b, c, d, e, f = map(float, pdf.placement(turn, mirror, 100, 50, 20, 10).split())
            corners = [(a * x + c * y + e, b * x + d * y + f) for x in (0, 1) for y in (0, 1)]
            x, y = zip(*corners, strict=True)
            assert (round(min(x)), round(max(x)), round(max(y) - min(y))) == (100, 120, 10)
    # a clockwise quarter turn takes the picture's top left corner (0, 1) to the top right of the box
    a, b, c, d, e, f = map(float, pdf.placement(90, False, 0, 0, 1, 1).split())
    assert (round(c + e), round(d + f, 2)) == (1, round(297 * 72 / 25.4, 2))


def test_export_and_import(spark, tmp_path):
    data = [(1, f"p{k}.x", bytearray(x), k) for k, x in enumerate([raster.to_png(PIXELS), bmp(PIXELS), jpeg(40, 30, 6), b"broken", raster.to_png(PIXELS[:, :, 0])])]
    photos_ = spark.createDataFrame(data, "album_id long, norm_path string, content binary, pos int")
    cells = raster.probe_images(photos_).select(
        "album_id", "norm_path", F.col("norm_path").alias("path"), "pos", (F.col("pos") * 90 % 360).alias("rotation"), F.lit("2x2").alias("layout"), "width", "height", "exif_orientation"
    )
    done = pdf.export_pdf(place(paginate(cells)), photos_, str(tmp_path)).collect()
    assert [(r["album_id"], r["n_pages"], r["n_photos"], r["n_undrawn"]) for r in done] == [(1, 2, 4, 1)]
    assert done[0]["bytes"] == os.path.getsize(done[0]["out_path"])
    files = scan.with_content(scan.scan_pdfs(spark, str(tmp_path)).select("path"))
    back = pdf.import_own_pdf(files)
    assert rows(back, "path", "pos", "rotation", "layout") == [(f"p{k}.x", k, k * 90 % 360, "2x2") for k in range(5)]
    images = pdf.extract_pdf_images(files)
    got = {(r["src_page"], r["src_index"]): r for r in images.collect()}
    assert {k: r["format"] for k, r in got.items()} == {(0, 0): "png", (0, 1): "png", (0, 2): "jpeg", (1, 0): "png"}
    assert (raster.pixels_of(got[0, 0]["content"]) == PIXELS).all() and (raster.pixels_of(got[0, 1]["content"]) == PIXELS).all()
    assert bytes(got[0, 2]["content"]) == jpeg(40, 30, 6)


def foreign(kind="plain"):
    grey = np.full((9, 9), 255, np.uint8)
    grey[:4, :4], grey[5:, 5:] = 7, 9
    stream = zlib.compress(grey.tobytes())
    image = b"<< /Type /XObject /Subtype /Image /Width 9 /Height 9 /BitsPerComponent 8 /ColorSpace /DeviceGray /Filter /FlateDecode /Length 6 0 R >>"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        3: b"<< /Type /Page /Parent 2 0 R /Resources 4 0 R >>",
        4: b"<< /XObject << /Im 5 0 R >> >>",
        6: b"%d" % len(stream),
    }
    out = b"%PDF-1.5\n"
    if kind == "packed":
        inner = [(n, objects.pop(n)) for n in (2, 3, 4)]
        marks, body = [], b""
        for n, x in inner:
            marks += [n, len(body)]
            body += x + b" "
        head = " ".join(map(str, marks)).encode() + b" "
        packed = zlib.compress(head + body)
        objects[9] = b"<< /Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(head), len(packed)) + packed + b"\nendstream"
    for n, x in objects.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (n, x)
    out += b"5 0 obj\n" + image + b"\nstream\n" + stream + b"\nendstream\nendobj\n"
    return out + (b"trailer << /Encrypt 8 0 R /Root 1 0 R >>" if kind == "locked" else b"trailer << /Root 1 0 R >>")


def test_foreign_pdfs(spark):
    files = [("a.pdf", foreign()), ("b.pdf", foreign("packed")), ("c.pdf", foreign("locked")), ("d.pdf", b"no pdf"), ("e.pdf", b"%PDF-1.4\n")]
    df = spark.createDataFrame([(p, bytearray(x)) for p, x in files], "path string, content binary")
    images = pdf.extract_pdf_images(df)
    got = [(r["src_pdf"], r["width"], r["error"]) for r in images.orderBy("src_pdf").collect()]
    assert got == [("a.pdf", 9, None), ("b.pdf", 9, None), ("c.pdf", None, "encrypted"), ("d.pdf", None, "not a PDF")]
    parts = pdf.import_foreign_pdf(df, "gutters").filter("error IS NULL")
    assert rows(parts, "norm_path", "width") == [(f"{p}.pdf#p0i0k{k}", 4) for p in "ab" for k in (0, 1)]
    assert pdf.import_foreign_pdf(df, "grid", 3, 3).filter("width = 3").count() == 18
    assert pdf.import_foreign_pdf(df, "whole").filter("error IS NULL").count() == 2
    assert rows(pdf.is_own_pdf(df), "own") == [(False,)] * 5


def test_sheets_of_many_parts_keep_their_identities(spark):
    """More than a thousand parts a picture, one PDF in two spellings."""
    cells = np.full((99, 99), 255, np.uint8)
    cells[::3, ::3], cells[::3, 1::3], cells[1::3, ::3], cells[1::3, 1::3] = 7, 8, 9, 10
    images = spark.createDataFrame([("a.pdf", 0, k, None, "png", 99, 99, bytearray(raster.to_png(cells)), None) for k in (0, 1)], pdf.EXTRACTED)
    parts = pdf.split_page_gutters(images)
    assert parts.select("src_index", "src_part").distinct().count() == parts.count() == 2 * 33 * 33
    twice = spark.createDataFrame([(p, bytearray(foreign())) for p in ("/d/./a.pdf", "/d/a.pdf")], "path string, content binary")
    assert rows(pdf.import_foreign_pdf(twice), "norm_path") == [("/d/a.pdf#p0i0",)] * 2


def test_volumes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pdf, "VOLUME", 2)
    data = [(1, f"p{k}.x", bytearray(raster.to_png(PIXELS)), k) for k in range(9)]
    photos_ = spark.createDataFrame(data, "album_id long, norm_path string, content binary, pos int")
    cells = raster.probe_images(photos_).select("album_id", "norm_path", F.col("norm_path").alias("path"), "pos", F.lit(0).alias("rotation"), F.lit("1x1").alias("layout"), "width", "height", "exif_orientation")
    done = pdf.export_pdf(place(paginate(cells)), photos_, str(tmp_path)).collect()
    assert sorted((r["volume"], r["n_pages"], r["n_photos"]) for r in done) == [(0, 2, 2), (1, 2, 2), (2, 2, 2), (3, 2, 2), (4, 1, 1)]
    back = pdf.import_own_pdf(scan.with_content(scan.scan_pdfs(spark, str(tmp_path)).select("path")))
    assert rows(back, "path", "pos") == [(f"p{k}.x", k) for k in range(9)]


def test_scans_take_names_as_they_are(spark, tmp_path):
    names = ["2.JPG", "a[1].jpg", "照片 1%20.jpg", "_DSC1.jpg", ".h.jpg", "_sub/z.jpg", "n.txt", "b.pdf"]
    for n in names:
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    seen = lambda df: sorted(r["path"].rpartition("/")[2] for r in df.collect())
    assert seen(scan.scan_images(spark, str(tmp_path))) == ["2.JPG", "a[1].jpg", "照片 1%20.jpg"]
    assert seen(scan.scan_images(spark, str(tmp_path), hidden=True)) == sorted([".h.jpg", "2.JPG", "_DSC1.jpg", "a[1].jpg", "z.jpg", "照片 1%20.jpg"])
    assert seen(scan.scan_pdfs(spark, str(tmp_path))) == ["b.pdf"]
    assert seen(scan.load_paths(spark, [f"{tmp_path}/a[1].jpg"])) == ["a[1].jpg"]
    assert seen(scan.load_paths(spark, [f"{tmp_path}/_DSC1.jpg"])) == ["_DSC1.jpg"]
    both = scan.load_paths(spark, [f"{tmp_path}/_DSC1.jpg", f"{tmp_path}/2.JPG"])
    assert seen(both) == ["2.JPG", "_DSC1.jpg"] and all(r["path"].startswith("file:") for r in both.collect())
    os.symlink(tmp_path / "nowhere.jpg", tmp_path / "dangling.jpg")
    assert len(seen(scan.scan_images(spark, str(tmp_path), hidden=True))) == 6
    assert len(seen(scan.scan_files(spark, str(tmp_path), recursive=False, hidden=True))) == 7
    there = scan.with_content_of(spark, scan.load_paths(spark, [f"{tmp_path}/2.JPG"]), str(tmp_path))
    assert [bytes(r["content"]) for r in there.collect()] == [b"x"]
    got = scan.with_content(scan.load_paths(spark, [f"{tmp_path}/a[1].jpg"]).unionByName(spark.createDataFrame([("gone.jpg", None, 0)], "path string, modificationTime timestamp, length bigint")))
    assert sorted(bytes(r["content"] or b"") for r in got.collect()) == [b"", b"x"]


def test_watched_folder(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.jpg").write_bytes(b"x")
    for name in ("b.png", "c.txt"):
        watch_folder(spark, str(folder), str(tmp_path / "cp"), 5, lambda b: seen.append(sorted(r["path"][-5:] for r in b.collect()))).awaitTermination()
        (folder / name).write_bytes(b"y")
    watch_folder(spark, str(folder), str(tmp_path / "cp"), 5, lambda b: seen.append(sorted(r["path"][-5:] for r in b.collect()))).awaitTermination()
    assert [x for x in seen if x] == [["a.jpg"], ["b.png"]]


def test_sources_join_one_list(spark):
    images = spark.createDataFrame([("a.jpg",)], "norm_path string")
    split = spark.createDataFrame([("x.pdf#p0i0", "x.pdf")], "norm_path string, src_pdf string")
    assert rows(photos.union_sources(images, split), "norm_path", "src_pdf") == [("a.jpg", None), ("x.pdf#p0i0", "x.pdf")]
