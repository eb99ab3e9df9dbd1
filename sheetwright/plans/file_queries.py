"""Queries on files that Spark makes of the ``embeddings`` table: each vector is a grey 8 x 8 picture.

An album is a label, a photo a vector; files go to the shared folder, one set for each run.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pages import paginate, place
from ..operators.photos import moved_originals
from ..sources import pdf, ranges, raster, scan
from ..sources.snapshots import ManifestTable
from ..streaming.watch import watch_into
from .queries import query, spark_dir

#: Grey value of a component, at most 254, so that only gutters are white.
_GREY = "CAST(least(254, greatest(0, floor((CAST({} AS DOUBLE) + 1) * 127))) AS INTEGER)"
_PIXELS = f"""px AS (SELECT vec_id, label, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, {_GREY.format("embedding[i + 1]")} AS g
  FROM embeddings, unnest(range(64)) u(i))"""


def pictures(spark: SparkSession, sf_dir: str, gutters: bool = False) -> DataFrame:
    """vec_id, label, content (PNG); gutters: rows and columns 3 and 4 are white."""
    grey = F.transform("embedding", lambda v: F.least(F.lit(254), F.greatest(F.lit(0), F.floor((v.cast("double") + 1) * 127))).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("label").cast("long").alias("label"), grey.alias("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for g in b.column(2).to_pylist():
                p = np.array(g, np.uint8).reshape(8, 8)
                if gutters:
                    p[3:5], p[:, 3:5] = 255, 255
                out.append(raster.to_png(p))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "content"])

    return rows.mapInArrow(run, "vec_id long, label long, content binary")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{spark_dir(spark)}/sheetwright/{name}-{uuid.uuid4().hex}"


def exported(spark: SparkSession, sf_dir: str, gutters: bool = False) -> DataFrame:
    """(path, content) of the albums' PDFs, written to the shared folder and read again."""
    photos = pictures(spark, sf_dir, gutters).select("label", "vec_id", F.format_string("/vec/%010d.png", "vec_id").alias("norm_path"), "content")
    probed = raster.probe_images(photos)
    nth = F.expr("row_number() OVER (PARTITION BY label ORDER BY vec_id)")
    cells = probed.select(
        F.col("label").alias("album_id"), "norm_path", F.col("norm_path").alias("path"), (nth - 1).cast("int").alias("pos"),
        (F.col("vec_id") % 4 * 90).cast("int").alias("rotation"), F.lit("3x4").alias("layout"), "width", "height", "exif_orientation",
    )
    out = _folder(spark, "albums")
    pdf.export_pdf(place(paginate(cells)), photos, out).select("album_id", "out_path").collect()  # a row an album: runs the export
    return scan.with_content(scan.scan_pdfs(spark, out).select("path"))


def _album(path):
    return F.regexp_extract(path, r"album-(-?\d+)\.pdf", 1).cast("long")


def _grey_sum(images: DataFrame) -> DataFrame:
    """album_id, src_page, src_index, src_part, width, height, grey: the sum of a picture's pixels, each times its place (from 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = [raster.pixels_of(x.as_py()).ravel().astype(np.int64) for x in b.column(6)]
            total = [int(p @ np.arange(1, len(p) + 1)) for p in flat]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(total, pa.int64())], [*b.schema.names[:6], "grey"])

    rows = images.filter("error IS NULL").select(_album(F.col("src_pdf")).alias("album_id"), "src_page", "src_index", "src_part", "width", "height", "content")
    return rows.mapInArrow(run, "album_id long, src_page int, src_index int, src_part int, width int, height int, grey long")


_PAGED = f"""WITH {_PIXELS}, spots AS (SELECT vec_id, CAST(label AS BIGINT) AS album_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings)"""


@query(f"WITH {_PIXELS} SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id, 'png' AS format, 8 AS width, 8 AS height FROM px")
def x6_probe_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.probe_images(pictures(spark, sf_dir)).select("vec_id", "format", "width", "height")


@query(f"""{_PAGED} SELECT album_id, CAST(pos // 24000 AS INTEGER) AS volume, CAST(count(*) AS INTEGER) AS n_photos, CAST((count(*) + 11) // 12 AS INTEGER) AS n_pages FROM spots GROUP BY ALL""")
def s5_export_pdf(spark, sf_dir):
    photos = pictures(spark, sf_dir).select("label", "vec_id", F.format_string("/vec/%010d.png", "vec_id").alias("norm_path"), "content")
    nth = F.expr("row_number() OVER (PARTITION BY label ORDER BY vec_id)")
    cells = raster.probe_images(photos).select(
        F.col("label").alias("album_id"), "norm_path", F.col("norm_path").alias("path"), (nth - 1).cast("int").alias("pos"),
        F.lit(0).alias("rotation"), F.lit("3x4").alias("layout"), "width", "height", "exif_orientation",
    )
    return pdf.export_pdf(place(paginate(cells)), photos, _folder(spark, "albums")).select("album_id", "volume", "n_photos", "n_pages")


@query(f"""{_PAGED} SELECT album_id, CAST(pos // 12 AS INTEGER) AS page_no, CAST(count(*) AS INTEGER) AS n_photos, 0 AS n_undrawn FROM spots GROUP BY ALL""")
def x5_render_pages(spark, sf_dir):
    photos = pictures(spark, sf_dir).select("label", "vec_id", F.format_string("/vec/%010d.png", "vec_id").alias("norm_path"), "content")
    nth = F.expr("row_number() OVER (PARTITION BY label ORDER BY vec_id)")
    cells = raster.probe_images(photos).select(
        F.col("label").alias("album_id"), "norm_path", (nth - 1).cast("int").alias("pos"), F.lit(90).alias("rotation"), F.lit("3x4").alias("layout"), "width", "height", "exif_orientation"
    )
    return pdf.render_pages(place(paginate(cells)), photos).select("album_id", "page_no", "n_photos", "n_undrawn")


@query("""SELECT CAST(label AS BIGINT) AS album_id, '/vec/' || lpad(CAST(vec_id AS VARCHAR), 10, '0') || '.png' AS path,
CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS pos, CAST(vec_id % 4 * 90 AS INTEGER) AS rotation, '3x4' AS layout FROM embeddings""")
def s6_import_own_pdf(spark, sf_dir):
    return pdf.import_own_pdf(exported(spark, sf_dir))


@query("""SELECT DISTINCT 'album-' || CAST(label AS VARCHAR) || '.pdf' AS name, true AS own FROM embeddings
UNION ALL SELECT 'scan-' || CAST(vec_id AS VARCHAR) || '.pdf', false FROM embeddings""")
def p4_is_own_pdf(spark, sf_dir):
    other = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.format_string("/in/scan-%d.pdf", "vec_id").alias("path"), F.encode(F.concat(F.lit("%PDF-1.4\n% "), "vec_id"), "UTF-8").alias("content"))
    rows = pdf.is_own_pdf(exported(spark, sf_dir).select("path", "content").unionByName(other))
    return rows.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "own")


@query(f"""{_PAGED} SELECT album_id, CAST(pos // 12 AS INTEGER) AS src_page, CAST(pos % 12 AS INTEGER) AS src_index, CAST(NULL AS INTEGER) AS src_part, 8 AS width, 8 AS height, CAST(sum(g * (y * 8 + x + 1)) AS BIGINT) AS grey
FROM px JOIN spots USING (vec_id) GROUP BY ALL""")
def x1_extract_pdf_images(spark, sf_dir):
    return _grey_sum(pdf.extract_pdf_images(exported(spark, sf_dir)))


@query(f"""{_PAGED} SELECT album_id, CAST(pos // 12 AS INTEGER) AS src_page, 0 AS src_index, CAST(NULL AS INTEGER) AS src_part, 8 AS width, 8 AS height, CAST(sum(g * (y * 8 + x + 1)) AS BIGINT) AS grey
FROM px JOIN spots USING (vec_id) WHERE pos % 12 = 0 GROUP BY ALL""")
def x2_split_page_whole(spark, sf_dir):
    return _grey_sum(pdf.split_page_whole(pdf.extract_pdf_images(exported(spark, sf_dir))))


@query(f"""{_PAGED} SELECT album_id, CAST(pos // 12 AS INTEGER) AS src_page, CAST(pos % 12 AS INTEGER) AS src_index, CAST(y // 4 * 2 + x // 4 AS INTEGER) AS src_part, 4 AS width, 4 AS height, CAST(sum(g * (y % 4 * 4 + x % 4 + 1)) AS BIGINT) AS grey
FROM px JOIN spots USING (vec_id) GROUP BY ALL""")
def x3_split_page_grid(spark, sf_dir):
    return _grey_sum(pdf.split_page_grid(pdf.extract_pdf_images(exported(spark, sf_dir)), 2, 2))


@query(f"""{_PAGED} SELECT album_id, CAST(pos // 12 AS INTEGER) AS src_page, CAST(pos % 12 AS INTEGER) AS src_index, CAST(y // 4 * 2 + x // 4 AS INTEGER) AS src_part, 3 AS width, 3 AS height, CAST(sum(g * (y % 5 * 3 + x % 5 + 1)) AS BIGINT) AS grey
FROM px JOIN spots USING (vec_id) WHERE y NOT IN (3, 4) AND x NOT IN (3, 4) GROUP BY ALL""")
def x4_split_page_gutters(spark, sf_dir):
    return _grey_sum(pdf.split_page_gutters(pdf.extract_pdf_images(exported(spark, sf_dir, gutters=True))))


@query(f"""{_PAGED} SELECT 'album-' || CAST(album_id AS VARCHAR) || '.pdf#p' || CAST(pos // 12 AS VARCHAR) || 'i' || CAST(pos % 12 AS VARCHAR) AS name FROM spots""")
def s7_import_foreign_pdf(spark, sf_dir):
    rows = pdf.import_foreign_pdf(exported(spark, sf_dir))
    return rows.select(F.regexp_extract("norm_path", r"([^/]+)$", 1).alias("name"))


def _written(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Writes files (vec_id, name, content) below a mounted folder, each at once; (vec_id, path) of them."""
    root = pdf.mounted(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for vec_id, name, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                done.append(f"{root}/{name}")
                os.makedirs(os.path.dirname(done[-1]), exist_ok=True)
                part = f"{os.path.dirname(done[-1])}/.part-{vec_id}-{os.getpid()}"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, done[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string())], ["vec_id", "path"])

    files.select("vec_id", "name", "content").mapInArrow(run, "vec_id long, path string").write.parquet(f"{folder}.list")  # writes the files too
    return spark.read.schema("vec_id long, path string").parquet(f"{folder}.list")


def _picture_files(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A folder with a file for each vector, in folders by label, names of odd ids hidden; and (vec_id, path)."""
    out = _folder(spark, "pictures")
    hidden = F.when(F.col("vec_id") % 2 != 0, "_").otherwise("")
    name = F.concat("label", F.lit("/"), hidden, F.lit("picture ["), "vec_id", F.lit("] {a}.PNG"))
    return out, _written(spark, pictures(spark, sf_dir).withColumn("name", name), out)


def header_file(vec_id: int) -> bytes:
    """A file of one of four formats, sized 1 + id % 90 by 1 + id % 70, with a header and some bytes that are no picture."""
    kind, w, h, turn, rest = vec_id % 4, 1 + vec_id % 90, 1 + vec_id % 70, 1 + vec_id % 8, b"\0" * 9_000
    if kind == 0:
        body = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
        return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + body + struct.pack(">I", zlib.crc32(b"IHDR" + body)) + rest
    if kind == 1:
        return b"BM" + struct.pack("<IHHI", 54, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, -h, 1, 24, 0, 0, 0, 0, 0, 0) + rest
    entry = struct.pack(">HHIHH", 0x0112, 3, 1, turn, 0)
    if kind == 2:  # the directory is behind the rest
        sizes = struct.pack(">HHIHH", 256, 3, 1, w, 0) + struct.pack(">HHIHH", 257, 3, 1, h, 0)
        return b"MM\0*" + struct.pack(">I", 8 + len(rest)) + rest + struct.pack(">H", 3) + sizes + entry + b"\0\0\0\0"
    exif = b"Exif\0\0MM\0*\0\0\0\x08\0\x01" + entry + b"\0\0\0\0"
    segment = lambda mark, data: b"\xff" + mark + struct.pack(">H", len(data) + 2) + data
    return b"\xff\xd8" + segment(b"\xe1", exif) + segment(b"\xe2", rest) * 2 + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\x01\x11\0\xff\xd9"


@query("""SELECT CAST(vec_id AS BIGINT) AS vec_id, (['png', 'bmp', 'tiff', 'jpeg'])[CAST(vec_id % 4 AS INTEGER) + 1] AS format, CAST(1 + vec_id % 90 AS INTEGER) AS width,
CAST(1 + vec_id % 70 AS INTEGER) AS height, CASE WHEN vec_id % 4 >= 2 THEN CAST(1 + vec_id % 8 AS INTEGER) END AS exif_orientation, CAST(NULL AS VARCHAR) AS probe_error FROM embeddings""")
def x6_probe_paths(spark, sf_dir):
    out = _folder(spark, "headers")
    made = F.udf(header_file, "binary")(F.col("vec_id"))
    ids = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"))
    _written(spark, ids.select("vec_id", F.concat(F.lit("["), "vec_id", F.lit("].bin")).alias("name"), made.alias("content")), out)
    found = ranges.probe_paths(scan.scan_files(spark, out, hidden=True))
    return found.select(_vec_id("path"), "format", "width", "height", "exif_orientation", "probe_error")


@query("""SELECT CAST(label AS BIGINT) AS label, CAST(row_number() OVER (ORDER BY CAST(label AS VARCHAR) || ' of ' || CAST(n AS VARCHAR)) - 1 AS INTEGER) AS pos, CAST(n AS BIGINT) AS n
FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)""")
def watch_folder(spark, sf_dir):
    """A file for each label comes into a watched folder; then the same files again under a new checkpoint, which adds none."""
    out = _folder(spark, "arrivals")
    labels = pictures(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.min_by("content", "vec_id").alias("content"))
    _written(spark, labels.select(F.col("label").alias("vec_id"), F.format_string("%d of %d.png", "label", "n").alias("name"), "content"), out)
    table = ManifestTable(spark, _folder(spark, "watched"))
    for nth in (1, 2):
        watch_into(table, out, f"{out}.checkpoint-{nth}", 1).awaitTermination()
    part = lambda k: F.regexp_extract("path", r"(-?\d+) of (\d+)\.png", k).cast("long")
    return table.read().select(part(1).alias("label"), "pos", part(2).alias("n"))


@query("""WITH px AS (SELECT vec_id, label, CAST(list_transform(embedding, lambda v: CAST(least(254, greatest(0, floor((CAST(v AS DOUBLE) + 1) * 127))) AS INTEGER)) AS VARCHAR) AS g,
  CAST(label AS VARCHAR) || '/' || CASE WHEN vec_id % 2 = 1 THEN '_' ELSE '' END || 'picture [' || CAST(vec_id AS VARCHAR) || '] {a}.PNG' AS name FROM embeddings),
fresh AS (SELECT g, arg_min(vec_id, name) AS new_id, count(*) AS n_copies FROM px WHERE vec_id % 3 <> 1 GROUP BY g)
SELECT CAST(vec_id AS BIGINT) AS vec_id, 'found' AS state, CAST(NULL AS BIGINT) AS new_id, CAST(NULL AS BIGINT) AS n_copies FROM px WHERE vec_id % 3 = 1
UNION ALL SELECT vec_id, 'moved', new_id, n_copies FROM px JOIN fresh USING (g) WHERE vec_id % 3 = 0
UNION ALL SELECT vec_id, 'missing', NULL, NULL FROM px WHERE vec_id % 3 = 2""")
def j3_moved_originals(spark, sf_dir):
    """A third of the listed photos are in place, a third lie under other names, of a third the content is nowhere."""
    out, _ = _picture_files(spark, sf_dir)
    files = scan.scan_images(spark, out, hidden=True).select("path", "norm_path", "length")
    known = ranges.file_digests(ranges.file_digests(files, "head").withColumnRenamed("digest", "head"), "full").withColumnRenamed("digest", "full")
    vec_id = F.regexp_extract("path", r"\[(-?\d+)\]", 1).cast("long")
    third, here = vec_id % 3, F.concat(F.lit("/old/["), vec_id, F.lit("].png"))
    listed = known.select(
        F.when(third == 1, F.col("norm_path")).otherwise(here).alias("norm_path"), "length",
        F.when(third == 2, F.lit("none")).otherwise(F.col("head")).alias("head"), F.when(third == 2, F.lit("none")).otherwise(F.col("full")).alias("full"),
    )
    rows = moved_originals(listed, files, ranges.file_digests)
    return rows.select(_vec_id("norm_path"), "state", F.regexp_extract("new_path", r"\[(-?\d+)\]", 1).cast("long").alias("new_id"), "n_copies")


def _vec_id(path):
    return F.regexp_extract(path, r"\[(-?\d+)\]", 1).cast("long").alias("vec_id")


@query("SELECT CAST(vec_id AS BIGINT) AS vec_id, 'png' AS ext FROM embeddings")
def s1_scan_images(spark, sf_dir):
    out, _ = _picture_files(spark, sf_dir)
    return scan.scan_images(spark, re.sub(r"^file:/+", "/", out), hidden=True).select(_vec_id("path"), "ext")


@query("SELECT CAST(vec_id AS BIGINT) AS vec_id, 'png' AS ext FROM embeddings WHERE vec_id % 2 = 0")
def s1_scan_visible_images(spark, sf_dir):
    out, _ = _picture_files(spark, sf_dir)
    return scan.scan_images(spark, out).select(_vec_id("path"), "ext")


@query("SELECT DISTINCT 'album-' || CAST(label AS VARCHAR) || '.pdf' AS name FROM embeddings")
def s2_scan_pdfs(spark, sf_dir):
    return exported(spark, sf_dir).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))


@query("SELECT CAST(vec_id AS BIGINT) AS vec_id FROM embeddings")
def s3_load_paths(spark, sf_dir):
    _, files = _picture_files(spark, sf_dir)
    return scan.load_paths(spark, files).select(_vec_id("path"))
