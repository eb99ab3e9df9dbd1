"""The eight grids. Whether the first number of a name is rows is open; we take rows x cols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LAYOUTS

#: Fixed values: (rows, cols) of the grids.
GRIDS = ((1, 1), (2, 2), (2, 3), (3, 2), (3, 3), (3, 4), (4, 3), (4, 4))
DEFAULT = "3x3"


def layouts(spark: SparkSession) -> DataFrame:
    """name, rows, cols, capacity, is_default: eight rows."""
    rows = [(f"{r}x{c}", r, c, r * c, f"{r}x{c}" == DEFAULT) for r, c in GRIDS]
    return spark.createDataFrame(rows, LAYOUTS)


def with_layout(df: DataFrame) -> DataFrame:
    """Adds rows, cols and capacity of the row's layout; a null or unknown name is the default.

    The grids are eight constants, so they are an expression rather than a join.
    """
    names = [f"{r}x{c}" for r, c in GRIDS]
    name = F.when(F.col("layout").isin(*names), F.col("layout")).otherwise(F.lit(DEFAULT))
    pick = lambda f: F.element_at(F.create_map(*(x for n, g in zip(names, GRIDS, strict=True) for x in (F.lit(n), F.lit(f(*g))))), name)
    return df.withColumns(
        {"layout": name, "rows": pick(lambda r, c: r), "cols": pick(lambda r, c: c), "capacity": pick(lambda r, c: r * c)}
    )
