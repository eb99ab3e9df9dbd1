"""Placed cells kept for lookups: photo to page and page to photos without a full scan.

Rows are range-partitioned and sorted by album and page, so the footers' least and greatest values lead a page's lookup to
few row groups. A photo's place can't be told from its name, so norm_path has Parquet Bloom filters (where a row
group's names are all in its dictionary, that serves as well), and its lookup passes over row groups that can't hold it.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["album_id", "page_no", "slot"]
#: Bytes of a row group; smaller ones than usual, as a lookup wants a few rows.
GROUP_BYTES = 8 << 20
#: Names that are looked up by filters; more of them are joined.
FEW = 64


def write_cells(cells: DataFrame, path: str, group_bytes: int = GROUP_BYTES, names: int = 200_000) -> None:
    """Write paginated cells; names: photos that a row group's Bloom filter is made for."""
    rows = cells.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    writer = rows.write.option("parquet.block.size", group_bytes).option("parquet.bloom.filter.enabled#norm_path", "true")
    writer.option("parquet.bloom.filter.expected.ndv#norm_path", names).mode("errorifexists").parquet(path)


def page_photos(spark: SparkSession, path: str, pages: list[tuple[int, int]]) -> DataFrame:
    """The cells of some pages (album_id, page_no), in order."""
    wanted = [(F.col("album_id") == a) & (F.col("page_no") == p) for a, p in pages]
    return spark.read.parquet(path).filter(functools.reduce(operator.or_, wanted, F.lit(False))).orderBy(*ORDER)


def photo_places(spark: SparkSession, path: str, names: list[str] | DataFrame) -> DataFrame:
    """The cells of photos by norm_path. Up to FEW names meet the Bloom filters; a table of names (norm_path) is joined with a scan."""
    cells = spark.read.parquet(path)
    if isinstance(names, DataFrame):
        return cells.join(names.select("norm_path"), "norm_path", "left_semi")
    if len(names) > FEW:
        return cells.join(spark.createDataFrame([(n,) for n in names], "norm_path string"), "norm_path", "left_semi")
    # Each name is an equality of its own: Spark turns longer lists into one range from the least to the greatest.
    return cells.filter(functools.reduce(operator.or_, [F.col("norm_path") == n for n in names], F.lit(False)))
