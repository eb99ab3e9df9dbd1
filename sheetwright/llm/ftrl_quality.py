"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader.

It learns from a bounded, documented sample of labelled rows (SAMPLE); every text is scored.
A score is the sigmoid of a bias and the sparse dot product of weights and n-gram shares.
Beside n-grams of words it has two kinds of features made of them: word endings in which each
letter or digit stands for its kind, and one slot shared by all n-grams that repeat one word.

Edge cases: null and empty texts have no n-grams and score the sigmoid of the bias;
without usable labels every score is 0.5; a null doc_id is in the training fold of none
and not held out; each input row gives one row; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod
from .features import labelled_sample, mean_score, sample_features, shape_slots, sigmoid, train, word_ids, word_slots

BITS, ORDER = 18, 2
#: Labelled rows that the model learns from, at most.
SAMPLE = 12_000
#: FTRL-proximal: learning rate, its smoothing, L1 and L2 strengths, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 20.0, 1.0, 1e-4, 1e-4, 4
FOLDS, THRESHOLD = 5, 0.3


def families(text: bytes) -> list[np.ndarray]:
    ids, distinct = word_ids(text.split())
    return [*word_slots(ids, distinct, BITS, ORDER), shape_slots(ids, distinct, BITS)]


def fit_ftrl(rows) -> bytes:
    """Weights (2**BITS and the bias) after FTRL-proximal updates, one row at a time."""
    n = (1 << BITS) + 1
    z, g2, one = np.zeros(n), np.zeros(n), np.array([n - 1])
    weights = lambda zi, gi: np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(gi)) / ALPHA + L2))
    for _ in range(EPOCHS):
        for y, slots, values in rows:
            at, x = np.concatenate((slots, one)), np.concatenate((values, [0.1]))
            w = weights(z[at], g2[at])
            g = (sigmoid(float(w @ x)) - y) * x
            sigma = (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / ALPHA
            z[at] += g - sigma * w
            g2[at] += g * g
    w = weights(z, g2)
    w[-1] *= 0.1
    return w.astype(np.float32).tobytes()


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes:
    """The model, from labelled rows outside the held-out fold."""
    rows = labelled_sample(docs, labels, "quality", sample, crc_mod(F.col("doc_id"), FOLDS) != 0)
    return train(sample_features(rows, families, BITS), fit_ftrl)


def score_quality(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(shared.value, np.float32)
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            score = [float(w[-1]) + mean_score(families(t.as_py() or b""), w) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigmoid(np.array(score, np.float64)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    rows = score_quality(docs, train_quality(docs, labels, sample))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
