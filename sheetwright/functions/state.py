"""Edit state as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import STATE


def manifest_json(album_id: Column, layout: Column, cells: Column) -> Column:
    """The state of one album; cells: array of struct(pos, path, rotation) in order."""
    return F.to_json(F.struct(album_id.alias("album_id"), layout.alias("layout"), cells.alias("cells")))


def parse_manifest(text: Column) -> Column:
    """The struct of the declared schema; null fields where the text is no such state."""
    return F.from_json(text, STATE)
