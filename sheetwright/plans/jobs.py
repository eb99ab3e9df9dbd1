"""Whole jobs: folder to PDF, edited PDF to PDF, foreign PDFs to a list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edits as E
from ..operators.pages import paginate, place
from ..operators.photos import add_photos, dedupe_keep_first, incoming, number_albums, number_photos, with_paths
from ..schemas import MANIFEST
from ..session import shared_dir, written
from ..sources import pdf, ranges, raster, scan


def list_photos(photos: DataFrame, layout: str | None = None, even_albums: bool = False, long_albums: bool = False) -> DataFrame:
    """A manifest of photos (album_id, norm_path, path, src_seq): first copies, numbered.

    Dedupe and numbering shuffle on different keys. even_albums: there are many albums
    and none is huge, so one shuffle by album serves both. long_albums: an album may be too long to be
    numbered in one task, so albums lie over range partitions.
    """
    rows = dedupe_keep_first(photos.repartition("album_id") if even_albums else photos)
    if long_albums:
        shared_dir(photos.sparkSession)
    rows = number_albums(rows) if long_albums else number_photos(rows)
    return rows.select("album_id", "norm_path", "path", "pos", F.lit(0).alias("rotation"), F.lit(layout).cast("string").alias("layout"))


def export_manifest(manifest: DataFrame, files: DataFrame, out: str, sizes: DataFrame | None = None) -> DataFrame:
    """Write the albums of a manifest as PDFs; files: norm_path, content. Returns the table ``pdfs``.

    The files are written here, once; n_undrawn counts cells that stay blank, as their picture is missing or can't be drawn.
    sizes: what ranges.probe_paths found, by norm_path; without it the content is probed.
    """
    if sizes is None:
        sizes = raster.probe_images(files.select("norm_path", "content").dropDuplicates(["norm_path"]))
    sizes = sizes.select("norm_path", "width", "height", "exif_orientation")
    return written(pdf.export_pdf(place(paginate(manifest).join(sizes, "norm_path", "left")), files, out), "pdfs")


def folder_to_pdf(spark: SparkSession, roots: list[str] | str, out: str, album_id: int = 1, layout: str = "3x3", hidden: bool = False) -> DataFrame:
    """Scan folders, lay the photos out on A4 pages and write the album's PDF.

    Headers are probed by ranges, so a file is read as a whole once, when its page is drawn.
    """
    found = scan.scan_images(spark, roots, hidden=hidden)
    manifest = list_photos(incoming(found, album_id), layout, long_albums=True)
    sizes = ranges.probe_paths(found.select("path", "norm_path").dropDuplicates(["norm_path"]))
    return export_manifest(manifest, scan.with_content(found.select("path", "norm_path")), out, sizes)


def edit_manifest(manifest: DataFrame, edits: DataFrame) -> DataFrame:
    """Turns, then drags in the order of seq."""
    return E.apply_moves(E.rotate(manifest, edits), edits).select(*MANIFEST.fieldNames())


def reopen(spark: SparkSession, pdfs: list[str]) -> DataFrame:
    """The manifest kept in PDFs of ours."""
    state = pdf.import_own_pdf(scan.with_content(scan.load_paths(spark, pdfs).select("path")))
    return with_paths(state, windows=False).select(*MANIFEST.fieldNames())


def add_foreign(manifest: DataFrame, pdfs: DataFrame, album_id: int, split: str = "extract", rows: int = 3, cols: int = 3) -> DataFrame:
    """The manifest with the photos of foreign PDFs (path, content) added behind its own, by PDF, page and place."""
    parts = pdf.import_foreign_pdf(pdfs, split, rows, cols).filter("error IS NULL")
    order = ["src_pdf", "src_page", "src_index", F.coalesce("src_part", F.lit(0)), "norm_path"]
    batch = parts.select(F.lit(album_id).cast("long").alias("album_id"), "norm_path", F.col("norm_path").alias("path"), F.struct(*order).alias("src_seq"))
    return add_photos(manifest, batch)
