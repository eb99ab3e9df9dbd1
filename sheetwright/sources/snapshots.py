"""A manifest kept as a table of versions: part folders of Parquet, and one small file a commit that names them.

A job first writes its rows to a new part; only then the commit file of the next version is put in place, by a
rename that fails if that version is there. So readers see a whole version or the one before, a job that dies leaves
the old state, an edited manifest can be saved where it was read, and of two writers that started from one
version the second gets CommitConflict and nothing of it is seen. Renames are Hadoop's, on any file system it knows.

Parts are of two kinds. ``rows``: photos that weren't listed when they were added. ``changes``: photos with new
values, or gone; they stand over what was written before them. Reading leaves rows out that a later
change names (an anti join with the changes alone, which are small and so broadcast by Spark) and adds the changes.
compact() makes one part of them, range-partitioned by album and position, so a hot album is in many tasks.
"""

from __future__ import annotations

import functools
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.photos import KEY, fresh_photos
from ..schemas import MANIFEST

_COLUMNS = MANIFEST.fieldNames()


class CommitConflict(RuntimeError):
    """Another writer has committed the version that this one was going to."""


class ManifestTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._files = self._at("log").getFileSystem(spark._jsc.hadoopConfiguration())

    # Versions

    def versions(self) -> list[int]:
        """Committed versions, from 1."""
        if not self._files.exists(self._at("log")):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._at("log"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def version(self) -> int:
        return max(self.versions(), default=0)

    def state(self, version: int | None = None) -> dict:
        """The commit of a version, by default the last: its parts in order, and the last batch of each source."""
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "parts": [], "batches": {}}
        stream = self._files.open(self._at(f"log/{version:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, base: dict, parts: list[dict], batch: tuple[str, int] | None = None) -> int:
        version = base["version"] + 1
        batches = {**base["batches"], **({batch[0]: batch[1]} if batch else {})}
        text = json.dumps({"version": version, "parts": parts, "batches": batches})
        jvm = self.spark._jvm
        part, final = self._at(f"log/.{uuid.uuid4().hex}.tmp"), self._at(f"log/{version:020d}.json")
        stream = self._files.create(part, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # doesn't overwrite
        try:
            context.rename(self._files.makeQualified(part), self._files.makeQualified(final), plain)
        except Py4JJavaError as e:
            self._files.delete(part, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise CommitConflict(f"version {version} of {self.path} was committed by another writer") from None
            raise
        return version

    def _part(self, df: DataFrame, kind: str) -> dict:
        name = f"parts/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return {"name": name, "kind": kind}

    # Reading

    def _read(self, part: dict, nth: int, changes: bool) -> DataFrame:
        schema = type(MANIFEST)([*MANIFEST.fields])  # a copy, as add() changes its own
        if changes:
            schema.add("gone", "boolean")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part['name']}").withColumn("_nth", F.lit(nth))

    def read(self, version: int | None = None) -> DataFrame:
        """The manifest of a version, by default the last."""
        parts = list(enumerate(self.state(version)["parts"]))
        rows = [self._read(p, k, False) for k, p in parts if p["kind"] == "rows"]
        changes = [self._read(p, k, True) for k, p in parts if p["kind"] == "changes"]
        union = lambda dfs: functools.reduce(DataFrame.unionByName, dfs)
        if not rows and not changes:
            return self.spark.createDataFrame([], MANIFEST)
        if not changes:
            return union(rows).select(*_COLUMNS)
        last = Window.partitionBy(*KEY).orderBy(F.desc("_nth"))
        over = union(changes).withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")
        now = over.filter(~F.col("gone")).select(*_COLUMNS)
        if not rows:
            return now
        named = over.select(*(F.col(c).alias(f"_{c}") for c in KEY), F.col("_nth").alias("_over"))
        listed = union(rows)
        hidden = (F.col("album_id") == F.col("_album_id")) & (F.col("norm_path") == F.col("_norm_path")) & (F.col("_nth") < F.col("_over"))
        return listed.join(named, hidden, "left_anti").select(*_COLUMNS).unionByName(now)

    # Writing; each call makes one version

    def replace(self, manifest: DataFrame) -> int:
        """Make manifest the whole table; it may have been read from it."""
        base = self.state()
        return self._commit(base, [self._part(_laid_out(manifest), "rows")])

    def add(self, incoming: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """add_photos into the table: only the photos that aren't listed are written.

        batch: (source, number) of a batch that may be delivered again; a number that isn't beyond the
        source's last one changes nothing. Returns the version that holds the batch.
        """
        base = self.state()
        if batch and base["batches"].get(batch[0], -1) >= batch[1]:
            return base["version"]
        part = self._part(fresh_photos(self.read(base["version"]), incoming), "rows")
        return self._commit(base, [*base["parts"], part], batch)

    def change(self, rows: DataFrame, gone: Column | None = None) -> int:
        """Write photos of the manifest with new values; where ``gone`` holds, they leave it. One row a photo."""
        base = self.state()
        gone = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
        return self._commit(base, [*base["parts"], self._part(rows.select(*_COLUMNS, gone.alias("gone")), "changes")])

    def save(self, edited: DataFrame) -> int:
        """Write what differs between an edited manifest and the table, as one change."""
        base = self.state()
        values = [c for c in _COLUMNS if c not in KEY]
        pack = lambda df, name: df.select(*KEY, F.struct(*values).alias(name))
        both = pack(self.read(base["version"]), "_old").join(pack(edited, "_new"), KEY, "full")
        both = both.filter(~F.col("_old").eqNullSafe(F.col("_new")))
        taken = F.coalesce("_new", "_old")
        rows = both.select(*KEY, *(taken[c].alias(c) for c in values), F.col("_new").isNull().alias("gone"))
        return self._commit(base, [*base["parts"], self._part(rows.select(*_COLUMNS, "gone"), "changes")])

    def compact(self) -> int:
        """One part of all; the content doesn't change."""
        base = self.state()
        return self._commit(base, [self._part(_laid_out(self.read(base["version"])), "rows")])

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete all but the last ``keep`` versions, and the parts that no version left names; returns these.

        For times without writers: a part that isn't committed yet is deleted too.
        """
        versions = self.versions()
        used = {p["name"] for v in versions[-keep:] for p in self.state(v)["parts"]}
        for v in versions[:-keep]:
            self._files.delete(self._at(f"log/{v:020d}.json"), False)
        there = [f"parts/{s.getPath().getName()}" for s in self._files.listStatus(self._at("parts"))] if self._files.exists(self._at("parts")) else []
        dead = [n for n in there if n not in used]
        for n in dead:
            self._files.delete(self._at(n), True)
        return dead


def _laid_out(manifest: DataFrame) -> DataFrame:
    return manifest.select(*_COLUMNS).repartitionByRange("album_id", "pos").sortWithinPartitions("album_id", "pos")
