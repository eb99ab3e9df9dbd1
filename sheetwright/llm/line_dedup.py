"""Line dedup over levelled sorted runs of line hashes.

A run is a table of line hashes, bucketed and sorted by hash. A batch of documents first
meets the runs in merge anti joins: hashes that no run holds are fresh, and the batch's
largest document with such a line keeps it. The fresh hashes become a run on level 0, so each
hash stands in one run only; of the others just their number of documents is noted. Once a
level holds ``fanout`` runs they are compacted into one run on the next level, so a store that
took n batches has about fanout * log(n) runs.

A line common to many documents makes its hash a hot key. It meets the written, small table
of repeated hashes in a plain join, which Spark may broadcast or split.

Edge cases: a null text is one empty line; a null doc_id counts as one document
that is smaller than any other; rows that repeat a doc_id count as one document;
only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, ascii_strip, cut, fresh_path, remove, text_or_empty

HASH = ["h1", "h2"]
RUN = "h1 long, h2 long, n_docs long, keeper long"
NO_ID = -(2**63)


def line_key(line: Column) -> Column:
    """The line without outer ASCII white space, A-Z lower-cased."""
    return ascii_lower(ascii_strip(line))


def key_hash(line: Column) -> Column:
    """128 bits of a line's key, as two longs."""
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


class LineRuns:
    """The levelled runs; rows are (h1, h2, n_docs, keeper), each hash in one run. ``later`` holds the counts of seen hashes."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout, self.paths = spark, fanout, {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.later: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = fresh_path(self.spark, name)
        (
            rows.repartition(self.buckets, *HASH)
            .sortWithinPartitions(*HASH)
            .write.bucketBy(self.buckets, *HASH)
            .sortBy(*HASH)
            .option("path", self.paths[name])
            .saveAsTable(name)
        )
        return name

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        remove(self.spark, self.paths.pop(run))

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys whose hash no run holds."""
        for run in self.runs():
            keys = keys.join(self.spark.table(run).select(*HASH).hint("merge"), HASH, "left_anti")
        return keys

    def add(self, batch: DataFrame) -> None:
        """Add the lines (h1, h2, doc_id), distinct, of documents smaller than all that the runs hold."""
        keys = batch.groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        if not self.runs():
            return self._push(0, self._write(keys))
        keys = cut(keys, "line-batch")
        run = self._write(self.unseen(keys))
        seen = keys.join(self.spark.table(run).select(*HASH).hint("merge"), HASH, "left_anti").select(*HASH, "n_docs")
        self.later.append(fresh_path(self.spark, "line-later"))
        # as many files as the batch's own size asks for: a file a bucket would be mostly small ones
        seen.coalesce(keys.rdd.getNumPartitions()).write.parquet(self.later[-1])
        self._push(0, run)

    def _rows(self, runs: list[str]) -> DataFrame:
        # Read as plain files: Spark 4.1 takes the buckets of a union of columnar bucketed scans for its
        # partitions (spark.sql.unionOutputPartitioning) though it only strings them together.
        return self.spark.read.schema(RUN).parquet(*(self.paths[run] for run in runs))

    def _push(self, level: int, run: str) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self._write(self._rows(old))
            for run in old:
                self._drop(run)
            self._push(level + 1, merged)

    def totals(self) -> DataFrame:
        """Each hash once: its documents over all batches and the document that keeps it."""
        rows = self._rows(self.runs())
        if not self.later:
            return rows
        later = self.spark.read.schema("h1 long, h2 long, n_docs long").parquet(*self.later)
        later = later.groupBy(*HASH).agg(F.sum("n_docs").alias("more"))
        return rows.join(later, HASH, "left").select(*HASH, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), "keeper")

    def close(self) -> None:
        """Drop the runs and what goes with them."""
        for run in self.runs():
            self._drop(run)
        for path in self.later:
            remove(self.spark, path)
        self.levels, self.later = [], []


def _places(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, body, pos, h1, h2) of each line that is long enough; body is a hash of its whole text."""
    text = text_or_empty(F.col("text"))
    lines = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.xxhash64(text).alias("body"),
        F.posexplode(F.split(text, "\n")).alias("pos", "line"),
    )
    lines = lines.filter(F.length(ascii_strip(F.col("line"))) >= min_chars)
    return lines.select("doc_id", "body", "pos", key_hash(F.col("line")).alias("h")).select("doc_id", "body", "pos", "h.h1", "h.h2")


def dedup_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 3, fanout: int = 2
) -> DataFrame:
    """Documents without the repeated lines: doc (all columns of docs), n_lines, n_dropped and ``kept``.

    Keys of at least min_chars code points found in at least min_docs documents lose
    all their lines but those in the largest doc_id that holds them. The documents
    reach the runs in ``batches`` batches, largest ids first, so the first run that
    holds a key names the document that keeps it.
    """
    spark = docs.sparkSession
    places = cut(_places(docs, min_chars), "line-places")
    cuts = [i / batches for i in range(1, batches)]
    bounds = docs.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", cuts, 0.01) if cuts else []
    batch = F.lit(0)
    for i, b in enumerate(bounds):
        batch = F.when(F.col("doc_id").cast("double") >= F.lit(b), F.lit(i + 1)).otherwise(batch)
    ids = cut(places.select("doc_id", *HASH).distinct().withColumn("batch", batch), "line-ids", partition_by="batch")
    runs = LineRuns(spark, fanout)
    for i in reversed(range(len(bounds) + 1)):
        runs.add(ids.filter(F.col("batch") == i).select(*HASH, "doc_id"))
    repeated = cut(runs.totals().filter(F.col("n_docs") >= min_docs).select(*HASH, "keeper"), "line-repeated")
    runs.close()
    drops = places.join(repeated, HASH).filter(F.col("doc_id") != F.col("keeper"))
    drops = cut(drops.groupBy("doc_id", "body").agg(F.collect_set("pos").alias("drops")), "line-drops")
    drops = drops.withColumnsRenamed({"doc_id": "line_doc", "body": "line_body"})
    out = docs.select(F.struct("*").alias("doc"), text_or_empty(F.col("text")).alias("body"))
    same_id = F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(NO_ID)) == F.col("line_doc")
    # merged at every size: a broadcast would only serve tables with few repeated lines
    out = out.join(drops.hint("merge"), same_id & (F.xxhash64("body") == F.col("line_body")), "left")
    # a column of its own, used more than once, so that it is split once and not for each line
    out, lines = out.withColumn("lines", F.split("body", "\n")), F.col("lines")
    # array_except works on hashed numbers: its time is that of the lines, however many of them go
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops"))
    stays = F.transform(stay, lambda i: F.element_at(lines, i + 1))
    return out.select(
        "doc",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.when(F.col("drops").isNotNull(), F.col("drops"))), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("body")).otherwise(F.array_join(stays, "\n")).alias("kept"),
    )
