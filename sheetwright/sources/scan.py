"""Listing files. Content is not selected here, so Spark does not read it.

Spark's binaryFile source leaves out names that begin with ``_`` or ``.``, as cameras
write them. hidden=True lists with the operating system instead, level by level (``walk``). The roots
must then be mounted on all executors.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.photos import keep_supported, with_paths
from ..session import written
from .ranges import open_ranges

_WALKED = "kind string, path string, modificationTime timestamp, length bigint, error string"
#: Entries that a task lists below one folder before it hands the folders that are left back to be dealt out.
ENTRIES = 20_000


def _mounted(path: str) -> str:
    return re.sub(r"^file:/*", "/", path)


def _descend(folder: str, recursive: bool, entries: int) -> Iterator[tuple]:
    """(kind, path, time, length, error) of what lies below a folder: files, errors, and folders that are still to be listed."""
    todo, seen = [folder], 0
    while todo:
        at = todo.pop()
        if seen >= entries:
            yield "folder", at, None, None, None
            continue
        try:
            names = os.scandir(at)
        except OSError as e:  # gone, or closed to us
            yield "error", f"file:{at}", None, None, e.strerror
            continue
        with names:
            for entry in names:
                seen += 1
                try:
                    if entry.is_dir(follow_symlinks=False):
                        if recursive:
                            todo.append(entry.path)
                        continue
                    i = entry.stat()
                except OSError:  # gone meanwhile, or a link to nowhere
                    continue
                if stat.S_ISREG(i.st_mode):
                    yield "file", f"file:{entry.path}", int(i.st_mtime * 1e6), i.st_size, None


def walk(spark: SparkSession, roots: list[str], recursive: bool = True, entries: int = ENTRIES) -> DataFrame:
    """kind (file or error), path, modificationTime, length, error of what lies below mounted folders, hidden names too.

    Level by level: the folders of a level are dealt out to all tasks, and a task that has listed ``entries``
    entries below one folder hands the folders that are left back to the next level. So no task walks a whole tree, a deep and
    narrow one takes few levels, and each level is written to the shared folder. A root may be a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                if os.path.isfile(folder):
                    i = os.stat(folder)
                    found = iter([("file", f"file:{folder}", int(i.st_mtime * 1e6), i.st_size, None)])
                else:
                    found = _descend(folder, recursive, entries)
                while rows := list(itertools.islice(found, 10_000)):
                    kind, path, when, size, error = zip(*rows)
                    when = pa.array(when, pa.int64()).cast(pa.timestamp("us", "UTC"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(kind, pa.string()), pa.array(path, pa.string()), when, pa.array(size, pa.int64()), pa.array(error, pa.string())],
                        ["kind", "path", "modificationTime", "length", "error"],
                    )

    todo = spark.createDataFrame([(os.path.abspath(_mounted(r)),) for r in roots], "path string").distinct()
    levels, n = [], len(roots)
    while n:
        tasks = min(n, 4 * spark.sparkContext.defaultParallelism)
        dealt = todo.repartition(tasks, F.xxhash64("path")) if n > 1 else todo
        levels.append(written(dealt.mapInArrow(run, _WALKED), "listing"))
        todo = levels[-1].filter("kind = 'folder'").select("path")
        n = todo.count()
    empty = spark.createDataFrame([], _WALKED)
    return functools.reduce(DataFrame.unionByName, levels, empty).filter("kind <> 'folder'")


def _walk(spark: SparkSession, roots: list[str], recursive: bool) -> DataFrame:
    return walk(spark, roots, recursive).filter("kind = 'file'").select("path", "modificationTime", "length")


def listing_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (added, changed, gone) between two listings; files with the same length and time are left out.

    The columns of the later listing follow, of a gone file those of the earlier. Added and changed files are a
    batch for add_photos; gone ones are missing originals. Rows are shuffled once, by path.
    """
    rest = [c for c in before.columns if c != "path" and c in after.columns]
    pack = lambda df, name: df.select("path", F.struct(*rest).alias(name))
    both = pack(before, "_old").join(pack(after, "_new"), "path", "full")
    stays = F.struct("_old.length", "_old.modificationTime").eqNullSafe(F.struct("_new.length", "_new.modificationTime"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "gone").when(~stays, "changed")
    now = F.coalesce("_new", "_old")
    return both.withColumn("change", change).filter("change IS NOT NULL").select("path", "change", *(now[c].alias(c) for c in rest))


def scan_files(spark: SparkSession, roots: list[str] | str, recursive: bool = True, hidden: bool = False) -> DataFrame:
    """path, modificationTime, length of all files below the roots; of folders that can't be read, walk has error rows."""
    roots = [roots] if isinstance(roots, str) else list(roots)
    if hidden:
        return _walk(spark, roots, recursive)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(roots).select("path", "modificationTime", "length")


def scan_images(spark: SparkSession, roots: list[str] | str, recursive: bool = True, hidden: bool = False, windows: bool = False) -> DataFrame:
    """Images below the roots with norm_path, ext, name and media; operators.photos.incoming makes a batch of them."""
    return with_paths(keep_supported(scan_files(spark, roots, recursive, hidden)), windows=windows)


def scan_pdfs(spark: SparkSession, roots: list[str] | str, recursive: bool = True, hidden: bool = False, windows: bool = False) -> DataFrame:
    rows = with_paths(scan_files(spark, roots, recursive, hidden), windows=windows)
    return rows.filter("media = 'pdf'")


def load_paths(spark: SparkSession, paths: list[str] | DataFrame, missing: str = "error") -> DataFrame:
    """path, modificationTime, length of chosen files; their names are taken literally, hidden ones too.

    paths: a list, or a table with ``path``, which isn't collected. Each task asks for its own files, on any file
    system that Arrow knows; local ones are mounted. missing: "error" fails if a file can't be found, hidden or not; "skip"
    leaves it out; "keep" keeps its row, with nulls.
    """
    if missing not in ("error", "skip", "keep"):
        raise ValueError("missing is error, skip or keep")
    given = paths.select("path") if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p in b.column(0).to_pylist():
                name, found = stat_of(p)
                if found is None and missing == "error":
                    raise FileNotFoundError(p)
                if found or missing == "keep":
                    rows.append((name, *(found or (None, None))))
            name, when, size = zip(*rows) if rows else ((), (), ())
            when = pa.array(when, pa.int64()).cast(pa.timestamp("us", "UTC"))
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), when, pa.array(size, pa.int64())], ["path", "modificationTime", "length"])

    return given.mapInArrow(run, "path string, modificationTime timestamp, length bigint")


def stat_of(path: str) -> tuple[str, tuple[int, int] | None]:
    """(its URI, (time in microseconds, length) or None where there is no such file)."""
    if re.match(r"^(?!file:)[a-zA-Z][a-zA-Z0-9+.-]+://", path):
        import pyarrow.fs

        scheme, rest = path.split("://", 1)
        host, _, name = rest.partition("/")
        system, root = pyarrow.fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{host}/")
        info = system.get_file_info(f"{root.rstrip('/')}/{name}")
        return path, (info.mtime_ns // 1000, info.size) if info.is_file else None
    at = os.path.abspath(_mounted(path))
    try:
        i = os.stat(at)
    except OSError:
        return f"file:{at}", None
    return f"file:{at}", (int(i.st_mtime * 1e6), i.st_size) if stat.S_ISREG(i.st_mode) else None


def with_content_of(spark: SparkSession, files: DataFrame, roots: list[str] | str) -> DataFrame:
    """Adds content read by Spark from below the roots, on any file system that it knows; null where there is none."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    read = read.select(F.col("path").alias("_read"), "content")
    return files.join(read, F.col("path") == F.col("_read"), "left").drop("_read")


def with_content(files: DataFrame, errors: bool = False) -> DataFrame:
    """Adds content: each file is opened in its task, so only paths are shuffled. A file that can't be read gives null.

    Files are mounted, or on a file system that Arrow knows by its scheme. errors: add content_error, which says why content is null.
    """
    new = ["content", "content_error"] if errors else ["content"]
    fields = [f for f in files.schema.fields if f.name not in new]
    where = [f.name for f in fields].index("path")

    def read(path: str | None) -> tuple[bytes | None, str | None]:
        try:
            fetch, close = open_ranges(path or "")
        except (OSError, ValueError) as e:
            return None, str(e)
        try:
            parts, at = [], 0
            while data := fetch(at, 1 << 24):
                parts.append(data)
                at += len(data)
            return b"".join(parts), None
        except OSError as e:
            return None, str(e)
        finally:
            close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 16):
                some = b.slice(at, 16)
                data = [read(p) for p in some.column(where).to_pylist()]
                added = [pa.array([d[k] for d in data], kind) for k, kind in zip(range(len(new)), (pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*some.columns, *added], names=[*some.schema.names, *new])

    listing = files.select(*(f.name for f in fields))
    schema = type(listing.schema)([*listing.schema.fields]).add("content", "binary")
    return listing.mapInArrow(run, schema.add("content_error", "string") if errors else schema)
