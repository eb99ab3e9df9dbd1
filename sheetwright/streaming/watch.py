"""A watched folder: each trigger adds the new images to the manifest as one batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.photos import incoming, keep_supported, with_paths
from ..sources.snapshots import ManifestTable

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def _arrivals(spark: SparkSession, folder: str, album_id: int, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    files = reader.load(folder).select("path", "modificationTime", "length")
    return incoming(with_paths(keep_supported(files), windows=False), album_id)


def watch_folder(spark: SparkSession, folder: str, checkpoint: str, album_id: int, add: Callable[[DataFrame], None]) -> StreamingQuery:
    """Run add(batch) on the images that came since the last run; the batch is in add_photos' form.

    Files are remembered by Spark's checkpoint, duplicates by the manifest, so no state grows here.
    """
    batches = _arrivals(spark, folder, album_id, None)
    writer = batches.writeStream.foreachBatch(lambda batch, _: add(batch)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def watch_into(
    table: ManifestTable, folder: str, checkpoint: str, album_id: int, source: str | None = None, files_per_batch: int | None = None
) -> StreamingQuery:
    """Add the images that came since the last run to a manifest table, each batch exactly once.

    The commit that holds a batch's photos also holds its number, under the name of the source (by default the
    checkpoint). So a batch that Spark delivers again, as the job died between the commit and the
    checkpoint's own note, is known and changes nothing; one that died before its commit left nothing to see.
    """
    name = source or checkpoint

    def add(batch: DataFrame, number: int) -> None:
        table.add(batch, (name, number))

    batches = _arrivals(table.spark, folder, album_id, files_per_batch)
    return batches.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
