"""Manifests kept as tables: whole ones, as a short form of ``snapshots.ManifestTable``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .snapshots import ManifestTable


def write_manifest(df: DataFrame, path: str) -> int:
    """Keep edit state as a new version of the table at path, from which df may have been read; returns the version.

    Rows lie by album and position, and a long album in many files. Older versions stay until the table's vacuum().
    """
    return ManifestTable(df.sparkSession, path).replace(df)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last version."""
    return ManifestTable(spark, path).read()
