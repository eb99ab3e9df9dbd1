"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, which separates words everywhere in this subpackage.
SPACE = " \t\n\x0b\x0c\r"
#: One word, as a Java and Python pattern.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; the session has to name one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path and spark.sparkContext.master.startswith("local["):  # one machine, as in tests
        path = tempfile.mkdtemp(prefix="sheetwright-")
        spark.sparkContext.setCheckpointDir(path)
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sheetwright/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and executors may be lost."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    fields = [f for f in df.schema.fields if f.name != partition_by]
    schema = type(df.schema)(fields + [f for f in df.schema.fields if f.name == partition_by])
    return spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete what was written under path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def ascii_strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACE))


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def n_words(col: Column) -> Column:
    """Number of words of a text; 0 for null."""
    parts = F.split(F.coalesce(col, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def crc_mod(col: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo; null where the value is null."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8")) % modulus
