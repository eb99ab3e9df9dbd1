"""Large pictures as rows of tiles: turned by moving tiles, scaled by sums over tiles.

A tile is (picture, width, height, x, y, w, h, pixels): where it begins in its picture of width x height, its own size and
its pixels row by row. Tiles need not be alike, so a turned picture, whose small tiles come first, is cut no anew.
No row or task holds a picture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rasters import rotate_raster

TILE = ["picture", "width", "height", "x", "y", "w", "h", "pixels"]


def cut_tiles(pictures: DataFrame, size: int) -> DataFrame:
    """Tiles of at most size x size of small pictures (picture, width, height, pixels)."""
    steps = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    fits = F.size("pixels") == F.col("width") * F.col("height")
    rows = pictures.filter(fits).select("picture", "width", "height", "pixels", F.explode(steps(F.col("height"))).alias("y"))
    rows = rows.select("*", F.explode(steps(F.col("width"))).alias("x"))
    rows = rows.withColumns({"w": F.least(F.lit(size), F.col("width") - F.col("x")), "h": F.least(F.lit(size), F.col("height") - F.col("y"))})
    line = lambda r: F.slice("pixels", (F.col("y") + r) * F.col("width") + F.col("x") + 1, F.col("w"))
    return rows.withColumn("pixels", F.flatten(F.transform(F.sequence(F.lit(0), F.col("h") - 1), line))).select(*TILE)


def join_tiles(tiles: DataFrame) -> DataFrame:
    """picture, i, v: the pixels row by row, a row a pixel."""
    rows = tiles.select("picture", "width", "x", "y", "w", F.posexplode("pixels").alias("k", "v"))
    i = (F.col("y") + F.floor(F.col("k") / F.col("w"))) * F.col("width") + F.col("x") + F.col("k") % F.col("w")
    return rows.select("picture", i.cast("int").alias("i"), "v")


def turn_tiles(tiles: DataFrame, angle) -> DataFrame:
    """The pictures turned clockwise by angle (a column, a multiple of 90): a projection, no tile meets another."""
    quarter = F.pmod(angle, F.lit(360)).cast("int")
    side = quarter.isin(90, 270)
    x, y, w, h, wide, high = (F.col(c) for c in ("x", "y", "w", "h", "width", "height"))
    new_x = F.when(quarter == 90, high - y - h).when(quarter == 180, wide - x - w).when(quarter == 270, y).otherwise(x)
    new_y = F.when(quarter == 90, x).when(quarter == 180, high - y - h).when(quarter == 270, wide - x - w).otherwise(y)
    swap = lambda a, b: F.when(side, b).otherwise(a)
    # First, as in a select that names its own w and h Spark takes these for the ones in rotate_raster's lambda.
    tiles = tiles.withColumn("pixels", rotate_raster(F.col("pixels"), w, h, quarter))
    return tiles.select(
        "picture", swap(wide, high).alias("width"), swap(high, wide).alias("height"), new_x.alias("x"), new_y.alias("y"),
        swap(w, h).alias("w"), swap(h, w).alias("h"), "pixels",
    )


def scale_tiles(tiles: DataFrame, w2: int, h2: int) -> DataFrame:
    """picture, i, v: the pictures scaled to w2 x h2, each pixel the mean of the area that it covers; any ratio, up or down.

    A pixel gives each new pixel the part of its area that lies in it, as whole numbers of units (the picture is
    width * w2 by height * h2 units), so weights are exact. Sums are taken tile by tile before the shuffle.
    """
    rows = tiles.select("picture", "width", "height", "x", "y", "w", F.posexplode("pixels").alias("k", "v"))
    rows = rows.withColumns({"px": (F.col("x") + F.col("k") % F.col("w")).cast("long"), "py": (F.col("y") + F.floor(F.col("k") / F.col("w"))).cast("long")})

    def covered(at, size, new):
        first, last = F.floor(at * new / size), F.floor(((at + 1) * new - 1) / size)
        part = lambda t: F.least((at + 1) * new, (t + 1) * size) - F.greatest(at * new, t * size)
        return F.transform(F.sequence(first, last), lambda t: F.struct(t.alias("at"), part(t).alias("part")))

    wide, high = F.col("width").cast("long"), F.col("height").cast("long")
    rows = rows.select("picture", "width", "height", "v", F.explode(covered(F.col("px"), wide, w2)).alias("c"), covered(F.col("py"), high, h2).alias("rs"))
    rows = rows.select("picture", "width", "height", "v", "c", F.explode("rs").alias("r"))
    i = (F.col("r.at") * w2 + F.col("c.at")).cast("int")
    sums = rows.groupBy("picture", "width", "height", i.alias("i")).agg(F.sum(F.col("v").cast("double") * F.col("c.part") * F.col("r.part")).alias("s"))
    return sums.select("picture", "i", (F.col("s") / (F.col("width").cast("double") * F.col("height"))).alias("v"))
