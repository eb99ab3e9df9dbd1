"""Upkeep of photo lists: identity is (album_id, norm_path), order is explicit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import file_ext, file_name, media, normalize_path
from ..session import written

KEY = ["album_id", "norm_path"]


def with_paths(df: DataFrame, base: str | None = None, windows: bool = True) -> DataFrame:
    """Adds norm_path, ext, name and media of ``path``."""
    path = F.col("path")
    return df.withColumns(
        {"norm_path": normalize_path(path, base, windows), "ext": file_ext(path), "name": file_name(path), "media": media(path)}
    )


def keep_supported(df: DataFrame, tif: bool = False) -> DataFrame:
    """Rows whose path has a supported extension, in any case."""
    return df.filter(media(F.col("path"), tif) == "image")


def classify_media(df: DataFrame) -> DataFrame:
    return df.withColumn("media", media(F.col("path")))


def dedupe_keep_first(photos: DataFrame) -> DataFrame:
    """One row a photo, the first by src_seq; later copies are skipped."""
    first = Window.partitionBy(*KEY).orderBy("src_seq", "path")
    return photos.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")


def duplicate_report(photos: DataFrame) -> DataFrame:
    """album_id, norm_path, copies, skipped of photos that were added more than once."""
    seen = photos.groupBy(*KEY).agg(F.count("*").alias("copies"))
    return seen.filter("copies > 1").withColumn("skipped", F.col("copies") - 1)


def repeated_keys(photos: DataFrame) -> DataFrame:
    """album_id, _h1, _h2 of the identities that come more than once, by 128-bit hashes of norm_path.

    Counts are added up before the shuffle, which takes 32 bytes an identity and no paths.
    """
    return _hashed(photos).groupBy("album_id", "_h1", "_h2").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")


def _hashed(photos: DataFrame) -> DataFrame:
    null = F.col("norm_path").isNull()  # hashes pass over nulls, so these are told apart
    return photos.withColumns({"_h1": F.xxhash64("norm_path", null), "_h2": F.xxhash64(F.lit(1), "norm_path", null)})


def dedupe_keep_first_by_hash(photos: DataFrame) -> DataFrame:
    """dedupe_keep_first where most photos are there once: only those whose hash repeats are shuffled with their paths.

    Hashes only pick candidates, and these are compared by their paths, so a collision costs work and no row. The repeated
    hashes are written first, so that Spark knows their size and broadcasts them where they are few. The photos are read
    three times, so they should be a table.
    """
    rows, keys = _hashed(photos), written(repeated_keys(photos), "repeated-keys").select(F.col("album_id").alias("_album"), F.col("_h1").alias("_g1"), F.col("_h2").alias("_g2"))
    same = F.col("album_id").eqNullSafe(F.col("_album")) & (F.col("_h1") == F.col("_g1")) & (F.col("_h2") == F.col("_g2"))
    once, more = rows.join(keys, same, "left_anti"), rows.join(keys, same, "left_semi")
    return once.unionByName(dedupe_keep_first(more)).drop("_h1", "_h2")


def duplicate_report_by_hash(photos: DataFrame) -> DataFrame:
    """duplicate_report that shuffles paths of repeated hashes alone."""
    rows, keys = _hashed(photos), written(repeated_keys(photos), "repeated-keys").select(F.col("album_id").alias("_album"), F.col("_h1").alias("_g1"), F.col("_h2").alias("_g2"))
    same = F.col("album_id").eqNullSafe(F.col("_album")) & (F.col("_h1") == F.col("_g1")) & (F.col("_h2") == F.col("_g2"))
    return duplicate_report(rows.join(keys, same, "left_semi").select(*KEY))


def number_photos(photos: DataFrame) -> DataFrame:
    """Adds pos, 0 to n-1 in each album by src_seq. An album is sorted in one task; number_albums is for longer ones."""
    order = Window.partitionBy("album_id").orderBy("src_seq", "norm_path")
    return photos.withColumn("pos", (F.row_number().over(order) - 1).cast("int"))


def _placed(photos: DataFrame, order: list[str]) -> DataFrame:
    """The rows in range partitions by ``order``, with _part and _nth (their place in it).

    The order must have no ties. The rows are written to the checkpoint folder, so that
    whoever reads them again sees the same partitions.
    """
    if not photos.sparkSession.sparkContext.getCheckpointDir():
        raise ValueError("numbering over partitions needs spark.checkpoint.dir")
    ranged = photos.repartitionByRange(*order).sortWithinPartitions(*order)
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.select("*", F.spark_partition_id().alias("_part"), nth.alias("_nth")).checkpoint()


def number_global(photos: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos, 0 to n-1 over the whole list, for lists too long for one task.

    Rows are range-partitioned and sorted; the partitions' sizes (one row each) give their offsets.
    """
    placed = _placed(photos, order)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    return placed.join(offsets, "_part").withColumn("pos", F.col("_ahead") + F.col("_nth")).drop("_part", "_nth", "_n", "_ahead")


def number_albums(photos: DataFrame) -> DataFrame:
    """number_photos where an album is too long for one task: an album may lie in several range partitions.

    One row for each album in each partition gives the offsets; (src_seq, norm_path) must have no ties in an album.
    """
    placed = _placed(photos, ["album_id", "src_seq", "norm_path"])
    sizes = placed.groupBy("album_id", "_part").agg(F.count("*").alias("_n"), F.min("_nth").alias("_first"))
    ahead = Window.partitionBy("album_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("album_id", "_part", (F.coalesce(F.sum("_n").over(ahead), F.lit(0)) - F.col("_first")).alias("_ahead"))
    numbered = placed.join(offsets, ["album_id", "_part"]).withColumn("pos", (F.col("_ahead") + F.col("_nth")).cast("int"))
    return numbered.drop("_part", "_nth", "_ahead")


def union_sources(images: DataFrame, pdf_photos: DataFrame) -> DataFrame:
    """Image files and photos split from PDFs in one list; columns that one side lacks are null."""
    return images.unionByName(pdf_photos, allowMissingColumns=True)


def incoming(scan: DataFrame, album_id: int) -> DataFrame:
    """Scanned files as a batch for add_photos: album_id, path, norm_path, src_seq.

    One src_seq for all, so the batch is added in order of its normalised paths (our choice).
    """
    return scan.select(F.lit(album_id).cast("long").alias("album_id"), "path", "norm_path", F.lit(0).cast("long").alias("src_seq"))


def fresh_photos(manifest: DataFrame, incoming: DataFrame) -> DataFrame:
    """The photos of a batch that aren't listed yet, numbered behind the last pos of their albums.

    incoming: album_id, norm_path, path, src_seq. That new photos go to the end, and that
    the first copy stays, is our choice.
    """
    # First the hits in the manifest, for which Spark may broadcast a small batch; then the batch without them.
    hits = manifest.select(*KEY).join(incoming.select(*KEY), KEY, "left_semi").distinct()
    fresh = dedupe_keep_first(incoming).join(hits, KEY, "left_anti")
    last = manifest.groupBy("album_id").agg(F.max("pos").alias("_last"), F.first("layout", ignorenulls=True).alias("_layout"))
    fresh = number_photos(fresh).join(last, "album_id", "left")
    return fresh.select(
        "album_id",
        "norm_path",
        "path",
        (F.coalesce("_last", F.lit(-1)) + 1 + F.col("pos")).cast("int").alias("pos"),
        F.lit(0).alias("rotation"),
        F.col("_layout").alias("layout"),
    )


def add_photos(manifest: DataFrame, incoming: DataFrame) -> DataFrame:
    """The manifest with a batch appended: listed photos are skipped, the others follow the last pos."""
    return manifest.select("album_id", "norm_path", "path", "pos", "rotation", "layout").unionByName(fresh_photos(manifest, incoming))


def apply_state(photos: DataFrame, manifest: DataFrame) -> DataFrame:
    """Scanned photos with their stored pos, rotation and layout; rotation 0 where nothing is stored."""
    stored = manifest.select(*KEY, "pos", "rotation", "layout")
    return photos.join(stored, KEY, "left").withColumn("rotation", F.coalesce("rotation", F.lit(0)))


def resolve_originals(manifest: DataFrame, scan: DataFrame) -> DataFrame:
    """The manifest with ``found``: whether its file is among those scanned."""
    there = scan.select("norm_path").distinct().withColumn("found", F.lit(True))
    return manifest.join(there, "norm_path", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def present_originals(manifest: DataFrame, scan: DataFrame) -> DataFrame:
    return manifest.join(scan.select("norm_path"), "norm_path", "left_semi")


def missing_originals(manifest: DataFrame, scan: DataFrame) -> DataFrame:
    return manifest.join(scan.select("norm_path"), "norm_path", "left_anti")


def moved_originals(manifest: DataFrame, scan: DataFrame, digests: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """norm_path, state, new_path of each listed photo: found where it was, moved (its content is at new_path), or missing.

    manifest and scan: norm_path, length; ``scan`` also path. digests(files, part) gives files (with path) that have a ``digest``
    of their content; part is "head" (the first kilobytes) or "full", and of the manifest's photos it has them stored, as
    columns head and full. Content is looked at as late as it can be: missing photos are held against new files (those that aren't
    listed) of their length, what is left against their heads, and only pairs with equal heads against whole digests.
    Of several files with one content the first by path is new_path, and n_copies counts them.
    """
    there = scan.select("norm_path").distinct().withColumn("_there", F.lit(True))
    listed = manifest.join(there, "norm_path", "left")
    gone = listed.filter("_there IS NULL").select("norm_path", "length", "head", "full")
    new = scan.join(manifest.select("norm_path"), "norm_path", "left_anti").select(F.col("norm_path").alias("new_path"), "path", "length")
    some = new.join(gone.select("length").distinct(), "length", "left_semi")
    some = digests(some, "head").withColumnRenamed("digest", "head").join(gone.select("length", "head").distinct(), ["length", "head"], "left_semi")
    some = digests(some, "full").withColumnRenamed("digest", "full").groupBy("length", "full").agg(F.min("new_path").alias("new_path"), F.count("*").alias("n_copies"))
    found = gone.join(some, ["length", "full"], "left").select("norm_path", F.when(F.col("new_path").isNull(), "missing").otherwise("moved").alias("state"), "new_path", "n_copies")
    stays = listed.filter("_there").select("norm_path", F.lit("found").alias("state"), F.lit(None).cast("string").alias("new_path"), F.lit(None).cast("long").alias("n_copies"))
    return stays.unionByName(found)
