"""Declared schemas of the library's tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"bigint": T.LongType, "int": T.IntegerType, "string": T.StringType, "boolean": T.BooleanType, "binary": T.BinaryType}


def _struct(fields: str) -> T.StructType:
    """A schema from "name type" pairs; needs no session, unlike Spark's own parser."""
    return T.StructType([T.StructField(n, _TYPES[t]()) for n, t in (f.split() for f in fields.split(", "))])


PHOTOS = _struct(
    "album_id bigint, path string, norm_path string, ext string, media string, length bigint, src_seq bigint, src_pdf string, src_page int"
)
PROBE = _struct("format string, width int, height int, exif_orientation int, probe_error string")
MANIFEST = _struct("album_id bigint, norm_path string, path string, pos int, rotation int, layout string")
EDITS = _struct("album_id bigint, seq bigint, op string, norm_path string, from_pos int, to_pos int")
LAYOUTS = _struct("name string, rows int, cols int, capacity int, is_default boolean")
#: Edit state of one album, as kept in a PDF.
STATE = T.StructType(
    [*_struct("album_id bigint, layout string").fields, T.StructField("cells", T.ArrayType(_struct("pos int, path string, rotation int")))]
)
PDFS = _struct("album_id bigint, volume int, n_pages int, n_photos int, n_undrawn int, bytes bigint, out_path string")
EXTRACTED = _struct("src_pdf string, src_page int, src_index int, src_part int, format string, width int, height int, content binary, error string")
