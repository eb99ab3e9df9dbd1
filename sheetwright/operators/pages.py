"""Pages: row-major cells on portrait A4 (fill order and orientation are our choice)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import cell_rect, compose_rotation, exif_upright, fit_rect, rotated_size
from .layouts import GRIDS, with_layout


def paginate(manifest: DataFrame) -> DataFrame:
    """Adds page_no, slot, row and col to dense positions: a projection."""
    cells = with_layout(manifest)
    pos, cap, cols = F.col("pos"), F.col("capacity"), F.col("cols")
    return cells.withColumns(
        {
            "page_no": F.floor(pos / cap).cast("int"),
            "slot": (pos % cap).cast("int"),
            "row": F.floor((pos % cap) / cols).cast("int"),
            "col": ((pos % cap) % cols).cast("int"),
        }
    )


def place(cells: DataFrame, margin_mm: float = 10.0, gap_mm: float = 4.0) -> DataFrame:
    """Adds the cell's rectangle and the picture's, upright by EXIF and turned by the user.

    cells: paginated rows with width, height, exif_orientation, rotation. Fitting
    and centring is stated for printing; that it holds in cells is our choice.
    """
    upright = exif_upright(F.col("width"), F.col("height"), F.col("exif_orientation"))
    rows = cells.withColumn("_up", upright).withColumn("mirror", F.col("_up.mirror"))
    rows = rows.withColumn("turn", compose_rotation(F.col("_up.rotation"), F.col("rotation")))
    rows = rows.withColumn("_cell", cell_rect(F.col("row"), F.col("col"), F.col("rows"), F.col("cols"), margin_mm, gap_mm))
    rows = rows.withColumn("_size", rotated_size(F.col("_up.w"), F.col("_up.h"), F.col("rotation")))
    rows = rows.withColumn("_fit", fit_rect(F.col("_size.w"), F.col("_size.h"), F.col("_cell.w"), F.col("_cell.h")))
    return rows.select(
        *cells.columns,
        "mirror",
        "turn",
        *(F.col(f"_cell.{k}").alias(f"{k}_pt") for k in "xywh"),
        (F.col("_cell.x") + F.col("_fit.x")).alias("draw_x"),
        (F.col("_cell.y") + F.col("_fit.y")).alias("draw_y"),
        F.col("_fit.w").alias("draw_w"),
        F.col("_fit.h").alias("draw_h"),
    )


def page_count(manifest: DataFrame) -> DataFrame:
    """album_id, layout, n_photos, n_pages."""
    rows = with_layout(manifest).groupBy("album_id", "layout").agg(F.count("*").alias("n_photos"), F.first("capacity").alias("capacity"))
    return rows.select("album_id", "layout", "n_photos", F.ceil(F.col("n_photos") / F.col("capacity")).cast("long").alias("n_pages"))


def compare_layouts(manifest: DataFrame) -> DataFrame:
    """album_id, layout, n_pages, n_blank for each of the eight grids."""
    albums = manifest.groupBy("album_id").agg(F.count("*").alias("n_photos"))
    grids = F.array(*(F.struct(F.lit(f"{r}x{c}").alias("layout"), F.lit(r * c).alias("capacity")) for r, c in GRIDS))
    rows = albums.select("album_id", "n_photos", F.inline(grids))
    pages = F.ceil(F.col("n_photos") / F.col("capacity")).cast("long")
    return rows.select("album_id", "layout", pages.alias("n_pages"), (pages * F.col("capacity") - F.col("n_photos")).alias("n_blank"))


def page_view(cells: DataFrame, album_id: int, page_no: int) -> DataFrame:
    """The photos of one page, by slot."""
    return cells.filter((F.col("album_id") == album_id) & (F.col("page_no") == page_no)).orderBy("slot")


def locate_photo(cells: DataFrame, norm_path: str) -> DataFrame:
    """album_id, page_no, slot, row, col of each place of a photo."""
    return cells.filter(F.col("norm_path") == norm_path).select("album_id", "norm_path", "page_no", "slot", "row", "col")


def in_order(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy("album_id", "pos")


def first_pages(cells: DataFrame, k: int) -> DataFrame:
    """The first k pages of each album."""
    return cells.filter(F.col("page_no") < k)


def first_pages_of_list(photos: DataFrame, k: int, capacity: int = 9) -> DataFrame:
    """The photos of each album's first k pages, before they are numbered."""
    order = Window.partitionBy("album_id").orderBy("src_seq", "norm_path")
    return photos.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= k * capacity).drop("_nth")
