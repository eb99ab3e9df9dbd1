"""SimHash near-dedup at a stated Jaccard similarity of word shingles.

A text's set holds the XXH64 hashes of its distinct shingles of SHINGLE words (lower-cased
A-Z, ASCII white space; a shorter text is one shingle). Two texts link if the Jaccard
similarity of their sets is ``similarity`` or more. The work is on distinct sets, so exact
copies never meet each other.

Fingerprint: each bit of a hash and of a mixed form of it is a vote of its shingle; the signs
of the BITS sums of votes are the SimHash fingerprint. Sets of similarity s agree in the sign of
a sum with probability 1 - acos(2s / (1 + s)) / pi, so the radius is the expected distance
and SIGMAS standard deviations (31 of 128 bits at 0.8, where unlike texts differ in 64).

Candidates: a key by equal bits would lose most pairs so far apart. Instead each table turns
the vector of sums by fixed rotations and keeps the axis on which it is longest, with its
sign: near vectors share these far more often than bits of the same entropy. There are as many
rotations a table as hold random buckets to about BUCKET rows, and as many tables as find a
pair at the least similarity with probability RECALL; both follow from the number of rows.

Comparison: as in ``simhash``, bit-sliced within the buckets, in units of two chunks. Its
forests make classes of candidates. In each class every pair that isn't connected yet is then
checked exactly: chunks of whole sets meet in units, whose common shingles are counted by a product of their
incidence matrices; a unit gives a spanning forest of its links. Chunks are first compared with themselves, and what they link
is contracted, so a class of m copies of one text takes about m * CHUNK counts; m * m / 2 are only left
where candidates turn out not to be linked. Each unit has CHUNK rows a side.

Edge cases: texts without words are one group; a null doc_id counts as larger than any id, and
a component of null ids alone has a null component_id; rows that repeat a doc_id stay rows of
their own, each in the component of its text; only row, doc_id and text are read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .simhash import bucket_links, components

SEED, SHINGLE, SIMILARITY = 42, 5, 0.8
BITS, SIGMAS, RECALL, BUCKET = 128, 3.1, 0.995, 256
#: Rows and hashes of a chunk, about; columns of a product; texts that are turned at once.
CHUNK, WEIGHT, SLAB, TEXTS = 1024, 1 << 20, 4096, 128
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of one text, ascending."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)]
    return np.unique(np.array(hashes, np.uint64))


def votes(hashes: np.ndarray) -> np.ndarray:
    """The BITS sums of votes (+1 or -1 a shingle) of a set."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        h = hashes[at : at + (1 << 16)]
        m = (h ^ (h >> np.uint64(32))) * _MIX
        m = (m ^ (m >> np.uint64(32))) * _MIX
        both = np.stack((h, m ^ (m >> np.uint64(32))), axis=1)
        total += np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * total - len(hashes)


def radius_of(similarity: float) -> int:
    """Distance that pairs at a similarity keep, but for one in a thousand."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(BITS * p + SIGMAS * math.sqrt(BITS * p * (1 - p)))


@functools.lru_cache(2)
def rotations(n: int) -> np.ndarray:
    """n random rotations side by side."""
    rng = np.random.default_rng(SEED)
    return np.concatenate([np.linalg.qr(rng.standard_normal((BITS, BITS)))[0] for _ in range(n)], axis=1).astype(np.float32)


def longest_axes(sums: np.ndarray, n: int) -> np.ndarray:
    """(rows, n): the axis of each rotation on which a vector is longest, doubled, plus 1 where it points up."""
    turned = (sums.astype(np.float32) @ rotations(n)).reshape(len(sums), n, BITS)
    axis = np.abs(turned).argmax(axis=2)
    return 2 * axis + (np.take_along_axis(turned, axis[:, :, None], 2)[:, :, 0] > 0)


@functools.lru_cache(8)
def agreement(similarity: float) -> float:
    """How often vectors of sums at a similarity have one longest axis, by simulation."""
    cos, rng = 2 * similarity / (1 + similarity), np.random.default_rng(SEED)
    x, y = rng.standard_normal((2, 20_000, BITS))
    y = cos * x + math.sqrt(1 - cos * cos) * y
    return float((longest_axes(x, 1) == longest_axes(y, 1)).mean())


def tables_of(rows: int, similarity: float) -> tuple[int, int]:
    """(tables, rotations of a table) for a number of rows."""
    parts = max(2, math.ceil(math.log(max(rows, 1) / BUCKET, 2 * BITS)))
    return math.ceil(math.log(1 - RECALL) / math.log(1 - agreement(similarity) ** parts)), parts


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _prints(docs: DataFrame, shingle: int, tables: int, parts: int) -> DataFrame:
    """(row, doc_id, h1, h2, n, f0, f1, keys): 128 bits that name the set, its size, its fingerprint and its key in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                b = whole.slice(at, TEXTS)
                names, sizes, sums = [], [], np.zeros((b.num_rows, BITS), np.int64)
                for k, t in enumerate(b.column(2).cast(pa.binary())):
                    hashes = shingle_set(t.as_py(), shingle)
                    names.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    sizes.append(len(hashes))
                    sums[k] = votes(hashes)
                name = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
                fp = np.packbits(sums > 0, axis=1, bitorder="little").view(np.int64)
                axes = longest_axes(sums, tables * parts).reshape(b.num_rows, tables, parts)
                keys = np.zeros((b.num_rows, tables), np.int64)
                for p in range(parts):
                    keys = keys * (2 * BITS) + axes[:, :, p]
                columns = [pa.array(np.ascontiguousarray(c)) for c in (name[:, 0], name[:, 1], np.array(sizes, np.int64), fp[:, 0], fp[:, 1])]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns, _lists(list(keys))], ["row", "doc_id", "h1", "h2", "n", "f0", "f1", "keys"])

    rows = docs.select("row", F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "row long, doc_id long, h1 long, h2 long, n long, f0 long, f1 long, keys array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(row, hashes) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle).view(np.int64) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(sets)], ["row", "hashes"])

    return docs.select("row", F.col("text").cast("string")).mapInArrow(run, "row long, hashes array<long>")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets without repeats, not both empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def unit_links(side: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest (i, j) of the links of a unit. Rows are sorted by side.

    A unit with one side compares all its rows; with two, those of side 0 with those of side 1.
    """
    m, left = len(sets), int((side == 0).sum())
    one = left in (0, m)
    size = np.array([len(x) for x in sets])
    _, ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of, shared = np.repeat(np.arange(m), size), times[ids] > 1
    of, ids = of[shared], (np.cumsum(times > 1) - 1)[ids[shared]]
    order = np.argsort(ids, kind="stable")
    of, ids = of[order], ids[order]
    top = m if one else left
    both = np.zeros((top, m - (0 if one else left)), np.float32)
    for at in range(0, int(ids[-1]) + 1 if len(ids) else 0, SLAB):
        a, b = np.searchsorted(ids, (at, at + SLAB))
        x = np.zeros((m, min(SLAB, int(ids[-1]) + 1 - at)), np.float32)
        x[of[a:b], ids[a:b] - at] = 1.0
        both += x[:top] @ (x if one else x[left:]).T
    other = size if one else size[left:]
    near = both >= similarity * (size[:top, None] + other[None, :] - both)
    root, found = np.arange(m), []
    for i, j in zip(*np.nonzero(near), strict=True):
        j += 0 if one else left
        if root[i] != root[j]:
            root[root == root[j]] = root[i]
            found.append((int(i), int(j)))
    return found


def _forests(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (root, low, high, side, row, hashes), sorted by unit and side; a unit may go over batches."""
    held: list[tuple] = []

    def edges() -> pa.RecordBatch:
        row = np.array([x[2] for x in held], np.int64)
        found = unit_links(np.array([x[1] for x in held]), [x[3] for x in held], similarity)
        a, b = (pa.array(row[[x[k] for x in found]]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    for batch in batches:
        ends, flat = batch.column(5).offsets.to_numpy(), batch.column(5).values.to_numpy()
        for i, (*unit, side, row) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)):
            if held and held[0][0] != unit:
                if len(held) > 1:
                    yield edges()
                held = []
            held.append((unit, side, row, flat[ends[i] : ends[i + 1]].copy()))
    if len(held) > 1:
        yield edges()


def _chunks(many: Column, weight: Column, chunk: int) -> Column:
    return F.ceil(F.greatest(F.lit(1), many / chunk, weight / WEIGHT)).cast("int")


def _links_of(units: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Forests (a, b), written, of units given as rows (root, low, high, side, row)."""
    unit = ["root", "low", "high"]
    rows = units.join(sets, "row").select(*unit, "side", "row", "hashes").repartition(*unit).sortWithinPartitions(*unit, "side")
    return cut(rows.mapInArrow(lambda it: _forests(it, similarity), "a long, b long"), "exact-links")


def _dealt(rows: DataFrame, chunk: int, *over: str) -> DataFrame:
    """Rows (root, row, n) with chunks and own: how many chunks the rows of a class (and of ``over``) make, and a row's."""
    by = ["root", *over]
    sums = rows.groupBy(*by).agg(F.count("*").alias("many"), F.sum("n").alias("weight"))
    sums = cut(sums.select(*by, _chunks(F.col("many"), F.col("weight"), chunk).alias("chunks")), "chunks")
    return rows.join(sums, by).withColumn("own", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int"))


def _met(rows: DataFrame, others: Column) -> DataFrame:
    """Units (root, low, high, side, row) of rows with own: a row's chunk with each of the chunks ``others`` (an array)."""
    rows = rows.withColumn("other", F.explode(others))
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    return rows.select("root", low, high, (F.col("own") > F.col("other")).cast("int").alias("side"), "row")


def _labelled(rows: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Rows (root, row, n), written, with label: the least row of the component that the links give so far."""
    known = components(links.join(rows.select(F.col("row").alias("a")), "a", "left_semi")).select(F.col("v").alias("row"), F.col("root").alias("label"))
    return cut(rows.join(known, "row", "left").select("root", "row", "n", F.coalesce("label", "row").alias("label")), name)


def _checked(classes: DataFrame, docs: DataFrame, similarity: float, shingle: int, chunk: int) -> DataFrame:
    """Forests (a, b) of the exact links inside the classes (row, root, n).

    Each chunk is compared with itself. Of a class of several chunks only rows that aren't connected yet are then compared, so that
    a class of copies of one text costs in proportion to its rows: first a row of each component of several rows with the others of these,
    then all rows outside the class's largest component with all rows.
    """
    sets = cut(_sets(docs.join(classes.select("row"), "row", "left_semi"), shingle), "shingle-sets")
    dealt = cut(_dealt(classes.select("root", "row", "n"), chunk).select("root", "row", "n", "chunks", "own"), "candidate-classes")
    links = _links_of(_met(dealt, F.array("own")), sets, similarity)
    long = dealt.filter("chunks > 1").select("root", "row", "n")
    if long.isEmpty():
        return links
    rows = _labelled(long, links, "contracted")
    heads = rows.groupBy("root", "label").agg(F.count("*").alias("k")).filter("k > 1").select("root", F.col("label").alias("row"))
    heads = _dealt(cut(heads.join(rows.select("row", "n"), "row").select("root", "row", "n"), "heads"), chunk)
    links = links.unionByName(_links_of(_met(heads, F.sequence(F.lit(0), F.col("chunks") - 1)), sets, similarity))
    rows = _labelled(long, links, "contracted-again")
    sizes = rows.groupBy("root", "label").agg(F.count("*").alias("k"))
    main = cut(sizes.groupBy("root").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("parts")).filter("parts > 1"), "largest-parts")
    rows = rows.join(main, "root").select("root", "row", "n", (F.col("label") != F.col("main")).alias("minor"))
    rows = cut(_dealt(rows, chunk, "minor"), "unconnected")
    apart = rows.groupBy("root").agg(F.max(F.when(F.col("minor"), F.col("chunks"))).alias("few"), F.max(F.when(~F.col("minor"), F.col("chunks"))).alias("rest"))
    rows = rows.join(cut(apart, "unconnected-chunks"), "root")
    rows = rows.withColumn("own", F.when(F.col("minor"), F.col("own")).otherwise(F.col("own") + F.col("few")))  # the others' chunks are counted on
    last = F.when(F.col("minor"), F.col("few") + F.col("rest") - 1).otherwise(F.col("few") - 1)
    return links.unionByName(_links_of(_met(rows, F.sequence(F.lit(0), last)), sets, similarity))


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """(row, doc_id, component_id, first) for each row of docs; docs has a column ``row`` that names its rows.

    component_id, first: the doc_id and the row of the component's row with the least (doc_id, row).
    docs is read more than once and must give the same rows each time, so it has to be written.
    """
    prints = cut(_prints(docs, shingle, *tables_of(docs.count(), similarity)), "prints")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    copies = prints.groupBy("h1", "h2").agg(F.min("row").alias("set"), head.alias("head"), F.count("*").alias("many"))
    copies = cut(copies.filter("many > 1").drop("many"), "copies")  # written: a plain join, which Spark may split where copies are many
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    named = prints.join(copies, ["h1", "h2"], "left").withColumn("set", F.coalesce("set", "row")).withColumn("head", F.coalesce("head", own))
    named = cut(named.select("row", "doc_id", "set", "head", "n", "f0", "f1", F.when(F.col("row") == F.col("set"), F.col("keys")).alias("keys")), "sets")
    sets = named.filter("row = set AND n > 0")
    rows = sets.select(F.col("row").alias("v"), "f0", "f1", F.posexplode("keys").alias("t", "key"))
    rows = rows.select(F.shiftleft(F.col("t").cast("long"), 56).bitwiseOR(F.col("key")).alias("bucket"), "v", "f0", "f1")
    classes = components(bucket_links(rows, ["f0", "f1"], radius_of(similarity), chunk)).withColumnRenamed("v", "row")
    classes = cut(sets.select("row", "n").join(classes, "row"), "candidates")
    roots = cut(components(_checked(classes, docs, similarity, shingle, chunk)).withColumnRenamed("v", "set"), "components")
    least = named.filter("row = set").join(roots, "set").groupBy("root").agg(F.min("head").alias("least"))
    least = cut(roots.join(cut(least, "heads"), "root").select("set", "least"), "labels")
    out = named.join(least, "set", "left").withColumn("head", F.coalesce("least", "head"))
    return out.select("row", "doc_id", F.col("head.doc_id").alias("component_id"), F.col("head.row").alias("first"))
