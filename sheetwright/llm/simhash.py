"""SimHash near-dedup with bit-sliced comparison.

A document's fingerprint has 64 bits; two link at ``radius`` or fewer differing bits.
The work is on distinct fingerprints, so copies never meet each other.

Candidates: the 64 bits are cut into radius + 2 blocks. Fingerprints that link agree
in two whole blocks at least, so each pair of blocks gives a bucket key and no link
is lost. A bucket of more than CHUNK fingerprints is dealt into chunks, and each pair
of chunks is a unit of work of its own, named by bucket and chunks; no unit holds more
than about 2 * CHUNK rows.

Comparison: the rows of a task lie vertically, one bit plane a bit and 64 rows a word.
A row is compared with the words of its unit: planes are XORed with its bit and added
by carry-save counters (ones, twos, fours and so on), 64 distances at once. Words in
which every distance has passed the radius are given up. A unit yields a spanning
forest of its links, never all pairs; the forests meet in star contraction.

Edge cases: a null or empty text has fingerprint zero and links like any other; a null
doc_id counts as larger than any id, and a component of null ids alone has a null
component_id; rows that repeat a doc_id stay rows of their own; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SEED, SHINGLE, RADIUS, CHUNK = 42, 4, 4, 4096
NO_ID = 2**63 - 1
ALL, NONE = np.uint64(2**64 - 1), np.uint64(0)
#: Rows that a task compares at once, words of 64 rows that it holds at once, planes between looks at the counters.
ROWS, WORDS, STEP = 1 << 16, 1 << 16, 8


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text, as an unsigned number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fp = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _csa(a, b, c):
    """Carry-save adder: the sum bits and the carry bits of three words."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def close_words(fp: np.ndarray, planes: np.ndarray, row: np.ndarray, word: np.ndarray, radius: int = RADIUS):
    """For each (row, word): the rows of the word, as bits, within radius of the row.

    fp: rows x words of 64 bits. Returns (index into row and word, bits); words in which all
    exceed the radius are given up.
    """
    index = np.arange(len(row))
    count = [np.zeros(len(row), np.uint64) for _ in range(max(3, radius.bit_length()))]
    more = np.zeros(len(row), np.uint64)
    far = more
    for at in range(0, len(planes), STEP):
        x = [planes[j][word] ^ (NONE - ((fp[row, j >> 6] >> np.uint64(j & 63)) & np.uint64(1))) for j in range(at, at + STEP)]
        fours = []
        for k in range(0, STEP, 4):
            count[0], a = _csa(count[0], x[k], x[k + 1])
            count[0], b = _csa(count[0], x[k + 2], x[k + 3])
            count[1], c = _csa(count[1], a, b)
            fours.append(c)
        count[2], carry = _csa(count[2], *fours)
        for k in range(3, len(count)):
            count[k], carry = count[k] ^ carry, count[k] & carry
        more = more | carry
        if at + STEP <= radius:
            continue
        # count > radius, bit by bit from the top
        above, equal = more, ~more
        for k in reversed(range(len(count))):
            lim = ALL if radius >> k & 1 else NONE
            above = above | (equal & count[k] & ~lim)
            equal = equal & ~(count[k] ^ lim)
        far = above
        alive = far != ALL
        if not alive.all():
            index, row, word, more, far = (v[alive] for v in (index, row, word, more, far))
            count = [c[alive] for c in count]
    return index, ~far


def bit_planes(fp: np.ndarray) -> np.ndarray:
    """The fingerprints (rows x words) as planes; bit r of word w of plane k is bit k of fingerprint 64 * w + r."""
    padded = np.zeros((-(-len(fp) // 64) * 64, fp.shape[1]), np.uint64)
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i]; a label is the least row of its class."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def unit_forest(unit: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """label[r]: the least row that links reach from row r in its unit. Rows are sorted by unit (rows x columns), then side.

    A unit with one side compares all its rows; with two, those of side 0 with those of side 1.
    """
    n = len(fp)
    label, planes = np.arange(n), bit_planes(fp)
    start = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]).any(axis=1)])
    size = np.diff(np.r_[start, n])
    of = np.repeat(np.arange(len(start)), size)
    end = (start + size)[of]
    left = np.add.reduceat((side == 0).astype(np.int64), start)
    first = np.where((left < size)[of], (start + left)[of], np.arange(n) + 1)
    rows = np.flatnonzero((side == 0) & (first < end))
    low, high = first[rows] >> 6, (end[rows] - 1) >> 6
    ahead = np.cumsum(high - low + 1)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ahead, (ahead[at - 1] if at else 0) + WORDS, "right")))
        many = (high - low + 1)[at:to]
        row = np.repeat(rows[at:to], many)
        word = np.repeat(low[at:to], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        index, bits = close_words(fp, planes, row, word, radius)
        row, word = row[index], word[index]
        near = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, r = np.nonzero(near)
        a, b = row[i], word[i] * 64 + r
        inside = (b >= first[a]) & (b < end[a])
        _union(label, a[inside], b[inside])
        at = to
    return label


def _forests(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests (a, b) of rows (bucket, low, high, side, v, fp words), sorted; a unit may go over batches."""
    held: list[np.ndarray] = []

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        label = unit_forest(rows[:, :3], rows[:, 3], rows[:, 5:].copy().view(np.uint64), radius)
        r = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(rows[r, 4]), pa.array(rows[label[r], 4])], ["a", "b"])

    for b in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1))
        if sum(map(len, held)) >= ROWS:
            rows = np.concatenate(held)
            others = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
            whole = int(others[-1]) + 1 if len(others) else 0
            if whole:
                yield edges(rows[:whole])
            held = [rows[whole:]]
    if sum(map(len, held)):
        yield edges(np.concatenate(held))


def bucket_links(rows: DataFrame, words: list[str], radius: int, chunk: int) -> DataFrame:
    """(a, b): forests of the links inside the buckets of rows (bucket, v, words).

    A unit is a bucket and two of its chunks, named by all three. ``sizes`` is written first,
    so that the join with it is a plain one, which Spark may split where a bucket is hot.
    """
    sizes = cut(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "bucket-sizes")
    rows = rows.join(sizes, "bucket").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    unit = ["bucket", "low", "high"]
    rows = rows.select(
        "bucket",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "v",
        *words,
    )
    rows = rows.repartition(*unit).sortWithinPartitions(*unit, "side", "v")
    return rows.mapInArrow(lambda it: _forests(it, radius), "a long, b long").distinct()


def links(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): forests whose components are those of all links between the distinct fingerprints ``fp``."""
    blocks = radius + 2
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    part = lambda i: F.shiftrightunsigned("fp", bounds[i]).bitwiseAND(F.lit((1 << (bounds[i + 1] - bounds[i])) - 1))
    width = max(bounds[i + 1] - bounds[i] for i in range(blocks))
    pairs = list(combinations(range(blocks), 2))
    keys = [
        F.shiftleft(F.shiftleft(part(i), width).bitwiseOR(part(j)), 8).bitwiseOR(F.lit(k)) for k, (i, j) in enumerate(pairs)
    ]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("bucket")).select("bucket", F.col("fp").alias("v"), "fp")
    return bucket_links(rows, ["fp"], radius, chunk)


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the least vertex of the component of each vertex that has an edge.

    Alternating large-star and small-star contraction, each round written to the shared folder.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join is a plain one, which Spark may split where a vertex has many edges
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        edges = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    root = edges.select(F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(root.select(F.col("root").alias("v"), "root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs."""
    prints = cut(fingerprints(docs), "fingerprints")
    fps = prints.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("least"))
    fps = cut(fps, "distinct-fingerprints")
    roots = cut(components(links(fps, radius, chunk)), "components")
    named = cut(fps.join(roots.withColumnRenamed("v", "fp"), "fp"), "named-fingerprints")
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    first = named.select("fp", "root").join(first, "root").select("fp", "component_id")
    # Written first, so that the join is a plain one, which Spark may split where copies are many.
    label = fps.join(first, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    out = prints.join(cut(label, "fingerprint-labels"), "fp")
    return out.select("doc_id", "fp", F.nullif("component_id", F.lit(NO_ID)).alias("component_id"))
