"""Packed edit state as files of JSON lines, written by a Spark sink: a write is a command that happens once, or not at all.

Tasks write hidden part files to a mounted folder; the driver's commit puts one small file in place that names
the parts of the tasks that counted. Readers read what commits name. An aborted write names none of its parts and deletes
those that are there; vacuum_states deletes parts of tasks that ended later. A part of a task that was run twice is named once. Only
state rows are written here, no pictures.
"""

from __future__ import annotations

import glob
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

SCHEMA = "album_id long, block int, state string"


def _folder(path: str) -> str:
    if re.match(r"^(?!file:)[a-zA-Z][a-zA-Z0-9+.-]+:/", path):
        raise ValueError(f"{path} isn't a mounted folder")
    return re.sub(r"^file:/+", "/", path)


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        os.makedirs(self.folder, exist_ok=True)
        name, n = f".{self.job}-{uuid.uuid4().hex}.jsonl", 0
        with open(f"{self.folder}/{name}", "w", encoding="utf-8") as out:
            for b in iterator:
                for row in b.to_pylist():
                    out.write(json.dumps({k: row[k] for k in ("album_id", "block", "state")}, ensure_ascii=False) + "\n")
                    n += 1
        return Part(name, n)

    def commit(self, messages: list[Part | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        done = [m for m in messages if m is not None]
        nth = len(glob.glob(f"{self.folder}/commit-*.json"))
        temp = f"{self.folder}/.{self.job}.commit"
        with open(temp, "w", encoding="utf-8") as out:
            json.dump({"overwrite": self.overwrite, "parts": [m.name for m in done if m.rows], "rows": sum(m.rows for m in done)}, out)
        os.link(temp, f"{self.folder}/commit-{nth:010d}.json")  # fails if another writer took this number
        os.remove(temp)

    def abort(self, messages: list[Part | None]) -> None:
        for name in glob.glob(f"{self.folder}/.{self.job}-*.jsonl"):
            os.remove(name)


class StateSink(DataSource):
    """Format ``photo_states``; modes append and overwrite."""

    @classmethod
    def name(cls) -> str:
        return "photo_states"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(_folder(self.options["path"]), overwrite)


def write_states(states: DataFrame, path: str, mode: str = "append") -> None:
    """Write the rows of pack_manifest."""
    states.sparkSession.dataSource.register(StateSink)
    states.select("album_id", "block", "state").write.format("photo_states").mode(mode).save(path)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """The state rows of all commits since the last that overwrote."""
    folder, parts = _folder(path), []
    for name in sorted(glob.glob(f"{folder}/commit-*.json")):
        with open(name, encoding="utf-8") as f:
            commit = json.load(f)
        parts = ([] if commit["overwrite"] else parts) + commit["parts"]
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    named = spark.createDataFrame([(f"{folder}/{p}",) for p in parts], "path string").repartition(len(parts))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                with open(path, encoding="utf-8") as f:
                    for line in f:
                        r = json.loads(line)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r["album_id"]], pa.int64()), pa.array([r["block"]], pa.int32()), pa.array([r["state"]], pa.string())], ["album_id", "block", "state"]
                        )

    return named.mapInArrow(lines, SCHEMA)


def vacuum_states(path: str) -> list[str]:
    """Delete the parts that no commit names, and return them; for times without writers."""
    folder, named = _folder(path), set()
    for name in glob.glob(f"{folder}/commit-*.json"):
        with open(name, encoding="utf-8") as f:
            named |= set(json.load(f)["parts"])
    dead = sorted(set(map(os.path.basename, glob.glob(f"{folder}/.*.jsonl"))) - named)
    for name in dead:
        os.remove(f"{folder}/{name}")
    return dead
