"""Quality rules: fixed rules on counts, then a calibrated hashed n-gram model against a fixed threshold.

The model is a logistic regression over hashed n-grams of words (to ORDER) and of characters
(CHARS code points), each a share of its family. It is trained on a bounded, documented
sample of labelled rows (SAMPLE) by AdaGrad, one row at a time: with g the gradient of the
logistic loss and the ridge, and G the sum of its squares so far, w -= RATE * g / sqrt(G). A fifth
of the sample is set aside for Platt calibration, so that probabilities are right on rows it
hasn't learned from. Texts are scored whole, in Arrow batches.

Edge cases: null and empty texts have no words and fail the rules; without labels of
both kinds the model rejects nothing; each input row gives one row, and all its
columns come back inside ``doc``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import char_slots, labelled_sample, mean_score, sample_features, sigmoid, train, word_ids, word_slots

BITS, ORDER, CHARS = 18, 2, 4
#: Labelled rows that the model learns from, at most.
SAMPLE = 5_000
RATE, RIDGE, EPOCHS = 3.0, 1e-6, 4
#: Fixed thresholds: the least number of words, the most repeated words in a hundred, the least probability of quality.
MIN_WORDS, MAX_REPEAT, MIN_QUALITY = 50, 50, 0.3
SYMBOLS = "#*$%&|<>"
#: Rows of a batch that goes back to Spark.
ROWS = 1_000
_SPACES = " \t\n\x0b\x0c\r"


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words in 3-word windows that the text holds twice or more; ids are below distinct."""
    if len(ids) < 4:
        return 0
    if distinct < 1 << 21:
        key = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    else:
        _, at, n = np.unique(np.stack((ids[:-2], ids[1:-1], ids[2:]), 1), axis=0, return_inverse=True, return_counts=True)
    twice, hit = n[at] > 1, np.zeros(len(ids), bool)
    for k in range(3):
        hit[k : len(ids) - 2 + k] |= twice
    return int(hit.sum())


def counts(text: str, ids: np.ndarray, distinct: int) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return (
        len(ids),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids, distinct),
    )


def families(text: bytes) -> list[np.ndarray]:
    return [*word_slots(*word_ids(text.split()), BITS, ORDER), char_slots(text.decode(), BITS, CHARS)]


def fit_calibrated(rows) -> bytes:
    """Weights (2**BITS), the bias, and Platt's slope and offset, as float32."""
    n = (1 << BITS) + 1
    w, g2, one = np.zeros(n), np.full(n, 1e-8), np.array([n - 1])
    learn, held = [r for k, r in enumerate(rows) if k % 5], rows[::5]
    if len({r[0] for r in learn}) < 2 or len({r[0] for r in held}) < 2:
        w[-1] = 60.0
        return np.concatenate((w, [1.0, 0.0])).astype(np.float32).tobytes()
    for _ in range(EPOCHS):
        for y, slots, values in learn:
            at, x = np.concatenate((slots, one)), np.concatenate((values, [0.1]))
            g = (sigmoid(float(w[at] @ x)) - y) * x + RIDGE * w[at]
            g2[at] += g * g
            w[at] -= RATE * g / np.sqrt(g2[at])
    w[-1] *= 0.1
    s = np.array([float(w[r[1]] @ r[2]) + w[-1] for r in held])
    y = np.array([r[0] for r in held], float)
    y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method on Platt's two parameters
        p = sigmoid(a * s + b)
        d = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[d @ (s * s), d @ s], [d @ s, d.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, [(p - y) @ s, (p - y).sum()])
        a, b = a - step[0].clip(-1, 1), b - step[1].clip(-5, 5)
    return np.concatenate((w, [max(a, 1e-3), b])).astype(np.float32).tobytes()


def train_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes:
    return train(sample_features(labelled_sample(docs, labels, "quality", sample), families, BITS), fit_calibrated)


def judge(docs: DataFrame, model: bytes) -> DataFrame:
    """All columns of docs as c0, c1, ..., then _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words (long) and _quality (double)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words", "_quality"]
    plain, where = [f"c{k}" for k in range(len(docs.columns))], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(shared.value, np.float32)
        w, (bias, slope, offset) = w[:-3], w[-3:].astype(float)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):  # small batches out, as texts go with them
                b, rows = whole.slice(at, ROWS), []
                for t in b.column(where).cast(pa.string()):
                    text = t.as_py() or ""
                    ids, distinct = word_ids(text.encode().split())
                    grams = [*word_slots(ids, distinct, BITS, ORDER), char_slots(text, BITS, CHARS)]
                    quality = float(sigmoid(slope * (mean_score(grams, w) + bias) + offset))
                    rows.append((*counts(text, ids, len(distinct)), quality))
                new = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.float64()]
                arrays = [*b.columns, *(pa.array(v, k) for v, k in zip(new, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*plain, *names])

    flat = docs.toDF(*plain)
    new = T.StructType([T.StructField(n, T.DoubleType() if n == "_quality" else T.LongType()) for n in names])
    return flat.mapInArrow(run, T.StructType([*flat.schema.fields, *new.fields]))


def apply_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc (all columns of docs), the five counts, quality, base_failed and kept, a row for each row of docs."""
    rows = judge(docs, train_rules(docs, labels, sample))
    n = len(docs.columns)
    doc = F.struct(*(F.col(c).alias(old) for c, old in zip(rows.columns[:n], docs.columns, strict=True)))
    failed = (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > MAX_REPEAT * F.col("_n_words"))
    kept = ~failed & (F.col("_quality") >= MIN_QUALITY)
    return rows.select(
        doc.alias("doc"), *(F.col(c).alias(c[1:]) for c in rows.columns[n:]), failed.alias("base_failed"), kept.alias("kept")
    )
