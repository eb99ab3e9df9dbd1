"""Pixels as arrays, row by row. Pictures of real size go through sources.raster instead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotate_raster(pixels: Column, w: Column, h: Column, angle: Column) -> Column:
    """The pixels turned clockwise by angle, a multiple of 90; its width and height are rotated_size's."""
    quarter = F.pmod(angle, F.lit(360))
    n = w * h

    def source(i: Column) -> Column:
        wide = F.when(quarter.isin(90, 270), h).otherwise(w)
        y, x = F.floor(i / wide), i % wide
        return (
            F.when(quarter == 90, (h - 1 - x) * w + y)
            .when(quarter == 180, n - 1 - i)
            .when(quarter == 270, x * w + (w - 1 - y))
            .otherwise(i)
        )

    picked = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(pixels, (source(i) + 1).cast("int")))
    return F.when((n > 0) & (F.size(pixels) == n), picked)


def resize_raster(pixels: Column, w: Column, h: Column, w2: Column, h2: Column) -> Column:
    """The pixels shrunk to w2 x h2, each the mean of its block; null unless w2 divides w and h2 divides h."""
    bw, bh = F.floor(w / w2), F.floor(h / h2)

    def block(i: Column) -> Column:
        y, x = F.floor(i / w2) * bh, (i % w2) * bw
        rows = F.transform(
            F.sequence(F.lit(0), bh.cast("int") - 1),
            lambda r: F.aggregate(
                F.slice(pixels, ((y + r) * w + x + 1).cast("int"), bw.cast("int")), F.lit(0.0), lambda a, v: a + v.cast("double")
            ),
        )
        return F.aggregate(rows, F.lit(0.0), lambda a, v: a + v) / (bw * bh)

    fits = (w2 > 0) & (h2 > 0) & (w % w2 == 0) & (h % h2 == 0) & (F.size(pixels) == w * h)
    return F.when(fits, F.transform(F.sequence(F.lit(0), (w2 * h2 - 1).cast("int")), block))
