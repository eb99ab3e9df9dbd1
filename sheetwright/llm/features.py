"""Hashed n-gram features of texts, and the bounded samples of labelled rows that classifiers learn from."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of letters beyond ASCII count as small letters.
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h.astype(np.uint64) * _MIX) >> np.uint64(64 - bits)).astype(np.int32)


def word_ids(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Each word's place in the list of distinct words, and that list."""
    seen: dict[bytes, int] = {}
    ids = [seen.setdefault(w, len(seen)) for w in words]
    return np.array(ids, np.int64), list(seen)


def word_slots(ids: np.ndarray, distinct: list[bytes], bits: int, n: int) -> list[np.ndarray]:
    """Slots of the 1- to n-grams of words, an array for each order.

    An n-gram of one word n times shares its slot with those of all other words.
    """
    crc = np.fromiter(map(zlib.crc32, distinct), np.uint64, len(distinct))[ids] if len(ids) else np.zeros(0, np.uint64)
    out, h, same = [], crc, np.ones(len(crc), bool)
    for k in range(n):
        if k:
            same = same[:-1] & (crc[k:] == crc[:-k])
            h = h[:-1] * np.uint64(1000003) + crc[k:]
            out.append(_slot(np.where(same, np.uint64(0), h) + np.uint64(k + 1), bits))
        else:
            out.append(_slot(h + np.uint64(1), bits))
    return out


def shape_slots(ids: np.ndarray, distinct: list[bytes], bits: int, last: int = 3) -> np.ndarray:
    """Slots of the words' endings, in which each letter or digit stands for its kind."""
    if not len(ids):
        return np.zeros(0, np.int32)
    crc = np.fromiter((zlib.crc32(w[-last:].translate(_SHAPE)) for w in distinct), np.uint64, len(distinct))[ids]
    return _slot(crc + np.uint64(0x7F4A7C15), bits)


def char_slots(text: str, bits: int, n: int = 4) -> np.ndarray:
    """Slots of the n-grams of code points, white space runs as they are."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < n:
        return np.zeros(0, np.int32)
    h = c[: len(c) - n + 1].copy()
    for k in range(1, n):
        h *= np.uint64(1000003)
        h += c[k : len(c) - n + 1 + k]
    return _slot(h + np.uint64(0x5BD1E995), bits)


def sparse(families: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values): in each family of n-grams a feature's value is its share of the family."""
    slots, values = [], []
    for f in families:
        if len(f):
            s, n = np.unique(f, return_counts=True)
            slots.append(s)
            values.append((n / len(f)).astype(np.float32))
    if not slots:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    s, v = np.concatenate(slots), np.concatenate(values)
    s, at = np.unique(s, return_inverse=True)
    return s.astype(np.int32), np.bincount(at, v, len(s)).astype(np.float32)


def mean_score(families: list[np.ndarray], weights: np.ndarray) -> float:
    """The dot product of weights and sparse(families), without the sorting."""
    return float(sum(weights[f].mean(dtype=np.float64) for f in families if len(f)))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60.0, 60.0)))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, limit: int, keep: Column | None = None) -> DataFrame:
    """(doc_id, y, text) of at most ``limit`` labelled documents, those with the least hash of doc_id.

    The limit bounds what is broadcast and what one training task reads. Rows with a
    null id or label are out; a document with several labels takes the least, one with
    several texts the least too, so that an id gives one row however often it stands.
    """
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull())
    if keep is not None:
        rows = rows.filter(keep)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(target).cast("int").alias("y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return found.select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text"))


def sample_features(sample: DataFrame, families, bits: int) -> DataFrame:
    """(doc_id, y, slots, values) of a labelled sample; families maps a text's bytes to lists of slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sparse(families(t.as_py()), bits) for t in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary())],
                ["doc_id", "y", "slots", "values"],
            )

    return sample.mapInArrow(run, "doc_id long, y int, slots binary, values binary")


def train(features: DataFrame, fit) -> bytes:
    """Run fit(list of (y, slots, values), in order of a hash of the id) in one task; the sample is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for i, y, s, v in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                rows.append((zlib.crc32(str(i).encode()), i, s, v, y))
        rows.sort()
        model = fit([(r[4], np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    return bytes(features.coalesce(1).mapInArrow(run, "model binary").first()["model"])
