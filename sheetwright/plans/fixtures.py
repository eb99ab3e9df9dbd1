"""The driver's tables seen as photo tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions dealt out by part key, so that all kinds of media and spellings occur.
EXTENSIONS = ("jpg", "JPG", "png", "bmp", "pdf", "txt", "tif", "webp", "gif", "tiff", "jpeg", "PDF")
#: Spellings of one folder, dealt out by part key; they fold to c:/photos/.
SPELLINGS = ("C:\\Photos\\", "c:/photos/./", "C:\\Photos\\tmp\\..\\", "C:\\\\PHOTOS\\")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """album_id, path, norm_path, src_seq: albums are suppliers, a photo is an order line, order is by ship date."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    name = F.concat(F.lit("/photos/"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit("/"), F.col("l_linenumber").cast("string"))
    return rows.select(
        F.col("l_suppkey").alias("album_id"),
        F.concat(name, F.lit("/"), F.lpad(F.col("l_partkey").cast("string"), 10, "0"), F.lit(".jpg")).alias("path"),
        F.concat(name, F.lit(".jpg")).alias("norm_path"),
        F.unix_date(F.col("l_shipdate").cast("date")).cast("long").alias("src_seq"),
    )


PHOTOS_SQL = """photos AS (SELECT l_suppkey AS album_id,
  '/photos/' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '/' || CAST(l_linenumber AS VARCHAR) || '/' || lpad(CAST(l_partkey AS VARCHAR), 10, '0') || '.jpg' AS path,
  '/photos/' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '/' || CAST(l_linenumber AS VARCHAR) || '.jpg' AS norm_path,
  CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS src_seq FROM lineitem),
first AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY album_id, norm_path ORDER BY src_seq, path) AS nth FROM photos) WHERE nth = 1),
listed AS (SELECT *, CAST(row_number() OVER (PARTITION BY album_id ORDER BY src_seq, norm_path) - 1 AS INTEGER) AS pos FROM first)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path: each order line in one of four spellings and one of twelve extensions."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    spelling = F.element_at(F.array(*map(F.lit, SPELLINGS)), (F.col("l_partkey") % 4 + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("l_partkey") % 12 + 1).cast("int"))
    return rows.select(F.concat(spelling, F.concat_ws("_", "l_orderkey", "l_linenumber"), F.lit("."), ext).alias("path"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


PATHS_SQL = f"""paths AS (SELECT ({_sql_list(SPELLINGS)})[CAST(l_partkey % 4 AS INTEGER) + 1] || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) || '.'
  || ({_sql_list(EXTENSIONS)})[CAST(l_partkey % 12 AS INTEGER) + 1] AS path FROM lineitem)"""


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id columns, w, h, exif (1-8) and rotation of made-up pictures, one an order line."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        (F.lit(1000) + F.col("l_partkey") % 3000).cast("int").alias("w"),
        (F.lit(800) + F.col("l_linenumber") * 400).cast("int").alias("h"),
        (F.col("l_orderkey") % 8 + 1).cast("int").alias("exif"),
        (F.col("l_suppkey") % 4 * 90).cast("int").alias("rotation"),
    )


SIZES_SQL = """sizes AS (SELECT l_orderkey, l_linenumber, CAST(1000 + l_partkey % 3000 AS INTEGER) AS w, CAST(800 + l_linenumber * 400 AS INTEGER) AS h,
  CAST(l_orderkey % 8 + 1 AS INTEGER) AS exif, CAST(l_suppkey % 4 * 90 AS INTEGER) AS rotation FROM lineitem)"""


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edit log: clicks turn clockwise, views counter-clockwise, purchases drag in a list of nine."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    op = F.when(F.col("event_type") == "click", "rotate_cw").when(F.col("event_type") == "view", "rotate_ccw").when(F.col("event_type") == "purchase", "move")
    return rows.select(
        F.col("user_id").alias("album_id"),
        F.col("event_id").alias("seq"),
        op.alias("op"),
        F.concat(F.lit("photo"), F.col("event_id") % 9).alias("norm_path"),
        F.when(op == "move", k % 9).alias("from_pos"),
        F.when(op == "move", (F.floor("value") % 9).cast("int")).alias("to_pos"),
    ).filter(op.isNotNull())


EDITS_SQL = """edits AS (SELECT user_id AS album_id, event_id AS seq, 'photo' || CAST(event_id % 9 AS VARCHAR) AS norm_path,
  CASE event_type WHEN 'click' THEN 'rotate_cw' WHEN 'view' THEN 'rotate_ccw' WHEN 'purchase' THEN 'move' END AS op,
  CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 9 AS INTEGER) AS from_pos, CAST(floor(value) AS INTEGER) % 9 AS to_pos
  FROM events WHERE event_type IN ('click', 'view', 'purchase'))"""


def drags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drags in the albums of ``manifest``, one for every sixteenth part; some positions are behind an album's end."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_partkey % 16 = 0")
    return rows.select(
        F.col("l_suppkey").alias("album_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.lit("move").alias("op"), F.lit(None).cast("string").alias("norm_path"),
        (F.col("l_orderkey") % 620).cast("int").alias("from_pos"), (F.col("l_partkey") * 7 % 620).cast("int").alias("to_pos"),
    )


DRAGS_SQL = """drags AS (SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY seq, from_pos, to_pos) AS k FROM (
  SELECT l_suppkey AS album_id, l_orderkey * 8 + l_linenumber AS seq, CAST(l_orderkey % 620 AS INTEGER) AS from_pos, CAST(l_partkey * 7 % 620 AS INTEGER) AS to_pos FROM lineitem WHERE l_partkey % 16 = 0))"""


def nine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of nine photos for each album of the edit log."""
    albums = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("album_id")).distinct()
    rows = albums.select("album_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("pos"))
    name = F.concat(F.lit("photo"), F.col("pos"))
    return rows.select("album_id", name.alias("norm_path"), name.alias("path"), "pos", F.lit(0).alias("rotation"), F.lit("3x3").alias("layout"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deduped, numbered list of ``photos``; layouts by album."""
    from ..operators.layouts import GRIDS
    from ..operators.photos import dedupe_keep_first, number_photos

    rows = number_photos(dedupe_keep_first(photos(spark, sf_dir)))
    names = F.array(*(F.lit(f"{r}x{c}") for r, c in GRIDS), F.lit(None).cast("string"))
    layout = F.element_at(names, (F.col("album_id") % 9 + 1).cast("int"))
    return rows.select("album_id", "norm_path", "path", "pos", (F.col("pos") % 4 * 90).cast("int").alias("rotation"), layout.alias("layout"))


MANIFEST_SQL = (
    PHOTOS_SQL
    + """,
manifest AS (SELECT album_id, norm_path, path, pos, CAST(pos % 4 * 90 AS INTEGER) AS rotation,
  (['1x1', '2x2', '2x3', '3x2', '3x3', '3x4', '4x3', '4x4', NULL])[CAST(album_id % 9 AS INTEGER) + 1] AS layout FROM listed),
grids(name, rows, cols) AS (VALUES ('1x1', 1, 1), ('2x2', 2, 2), ('2x3', 2, 3), ('3x2', 3, 2), ('3x3', 3, 3), ('3x4', 3, 4), ('4x3', 4, 3), ('4x4', 4, 4)),
cells AS (SELECT album_id, norm_path, path, pos, rotation, name AS layout, rows, cols, rows * cols AS capacity, CAST(pos // (rows * cols) AS INTEGER) AS page_no,
  CAST(pos % (rows * cols) AS INTEGER) AS slot, CAST(pos % (rows * cols) // cols AS INTEGER) AS "row", CAST(pos % (rows * cols) % cols AS INTEGER) AS col
  FROM manifest JOIN grids ON name = coalesce(layout, '3x3'))"""
)
