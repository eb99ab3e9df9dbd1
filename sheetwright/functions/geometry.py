"""Geometry of cells and pictures on A4, in points; the origin is the page's top left corner."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO 216 and the size of a point.
A4_WIDTH_MM, A4_HEIGHT_MM, POINTS_PER_MM = 210.0, 297.0, 72.0 / 25.4


def fit_rect(w: Column, h: Column, box_w: Column, box_h: Column) -> Column:
    """struct(scale, x, y, w, h): the picture scaled with equal ratio to fit the box and centred in it.

    Null where a size is null, zero or negative.
    """
    scale = F.least(box_w / w, box_h / h)
    rect = F.struct(
        scale.alias("scale"),
        ((box_w - w * scale) / 2).alias("x"),
        ((box_h - h * scale) / 2).alias("y"),
        (w * scale).alias("w"),
        (h * scale).alias("h"),
    )
    return F.when((w > 0) & (h > 0) & (box_w > 0) & (box_h > 0), rect)


def cell_rect(row: Column, col: Column, rows: Column, cols: Column, margin_mm: float = 10.0, gap_mm: float = 4.0) -> Column:
    """struct(x, y, w, h) of a cell of a rows x cols grid on portrait A4; margin and gap are our choice."""
    w = (F.lit(A4_WIDTH_MM - 2 * margin_mm) - (cols - 1) * gap_mm) / cols
    h = (F.lit(A4_HEIGHT_MM - 2 * margin_mm) - (rows - 1) * gap_mm) / rows
    return F.struct(
        ((margin_mm + col * (w + gap_mm)) * POINTS_PER_MM).alias("x"),
        ((margin_mm + row * (h + gap_mm)) * POINTS_PER_MM).alias("y"),
        (w * POINTS_PER_MM).alias("w"),
        (h * POINTS_PER_MM).alias("h"),
    )


def rotated_size(w: Column, h: Column, rotation: Column) -> Column:
    """struct(w, h) after a turn by a multiple of 90 degrees."""
    across = F.pmod(rotation, F.lit(180)) == 90
    return F.struct(F.when(across, h).otherwise(w).alias("w"), F.when(across, w).otherwise(h).alias("h"))


def exif_upright(w: Column, h: Column, orientation: Column) -> Column:
    """struct(rotation, mirror, w, h) that shows a picture of an EXIF orientation upright.

    The mirror (left to right) comes first, then the clockwise rotation. Values outside 1-8 count as 1.
    """
    o = F.coalesce(orientation, F.lit(1))
    rotation = F.when(o.isin(3, 4), 180).when(o.isin(5, 8), 270).when(o.isin(6, 7), 90).otherwise(0)
    size = rotated_size(w, h, rotation)
    return F.struct(rotation.alias("rotation"), o.isin(2, 4, 5, 7).alias("mirror"), size["w"].alias("w"), size["h"].alias("h"))


def compose_rotation(exif: Column, user: Column) -> Column:
    """Total clockwise turn, 0 to 270; the mirror of the EXIF orientation has been applied before."""
    return F.pmod(exif + user, F.lit(360)).cast("int")
