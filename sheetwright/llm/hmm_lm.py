"""Hidden Markov language model: trained by Baum-Welch over partitions, scored by the scaled forward recursion.

Words are counted over all training texts. The commonest OWN_CLASSES words are emission
classes of their own; every other word falls into one of BUCKETS classes by its hash, and
within its class has probability (c + 1) / (tokens + types + 1 of the class). States emit
classes. So the model's tables are bounded while its counts cover every word, and

    log p(text) = log p(classes of the text; HMM) + sum of log p(word | class).

Each Baum-Welch round reads every training token; partitions add up expected counts and
only these sums (classes x states) reach the driver. Training and scoring both run over whole
texts. For training the texts of a batch are strung together in lanes that run side by side;
a lane starts anew at each text. The forward pass keeps the states at every STRETCH-th step
only; the backward pass computes those between again, so memory doesn't grow with a text.

Counts of common words (HEAD of them, a bounded table) are broadcast; those of all other
words meet the texts in a join, of a row for each text and rare word.

Edge cases: a null or empty text is one end token; a null doc_id is a training document;
with no training text every word has base probability 1; repeated rows stay rows of
their own; only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut

STATES, OWN_CLASSES, BUCKETS, HEAD, ROUNDS, SEED = 8, 16_384, 4_096, 262_144, 4, 42
FOLDS, HELD = 7, 2
#: Pseudo-count of each class in each state, and of each transition.
SMOOTH = 0.05
#: Lanes that a task runs side by side, steps between kept states; words it counts before it passes them on.
LANES, STRETCH, FLUSH = 512, 256, 200_000
END = b""
_TRANSITION, _INITIAL, _LIKELIHOOD = -1000, -2000, -3000


def words_of(text: bytes | None) -> list[bytes]:
    """The text's words, A-Z lower-cased, then the end token."""
    out = (text or b"").lower().split()
    out.append(END)
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, c) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for t in b.column(0).cast(pa.binary()):
                seen.update(words_of(t.as_py()))
                if len(seen) >= FLUSH:
                    yield flush()
                    seen.clear()
        yield flush()

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """The bounded part of the word counts."""

    head: bytes  # words joined by blanks, the commonest first
    counts: np.ndarray
    spread: np.ndarray  # tokens + types + 1 of each hashed class
    tokens: int
    types: int
    own: int = OWN_CLASSES
    buckets: int = BUCKETS

    def words(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.head.split(b" "))} if len(self.counts) else {}

    def classes(self) -> np.ndarray:
        """Class of each head word."""
        out = np.arange(len(self.counts))
        for i, w in enumerate(self.head.split(b" ")[self.own : len(self.counts)]):
            out[self.own + i] = self.own + zlib.crc32(w) % self.buckets
        return out.astype(np.uint16)

    def class_counts(self) -> np.ndarray:
        """About the tokens of each class, to start from."""
        out = np.concatenate((np.zeros(self.own), self.spread))
        out[: min(self.own, len(self.counts))] = self.counts[: self.own]
        return out


def common_words(counts: DataFrame, limit: int) -> DataFrame:
    """(word, c) of about the ``limit`` commonest words, from every partition its own.

    A histogram of counts (by value to 2**16, then by 1/1024 of a doubling, a bounded table) gives
    the level down to which all words fit; of the next level a part by hash fills the rest.
    """
    level = F.when(F.col("c") < 1 << 16, F.col("c")).otherwise((1 << 16) + F.floor(1024 * (F.log2("c") - 16))).cast("long")
    rows = counts.withColumn("level", level)
    room, least, part = limit, 0, 0.0
    for r in sorted(rows.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        if r["count"] > room:
            least, part = r["level"] + 1, room / r["count"]
            break
        room -= r["count"]
    of_next = (F.col("level") == least - 1) & (F.pmod(F.xxhash64("word"), F.lit(1 << 32)) < int(part * (1 << 32)))
    return rows.filter((F.col("level") >= least) | of_next).select("word", "c")


def vocabulary(counts: DataFrame, head: int = HEAD, own: int = OWN_CLASSES, buckets: int = BUCKETS) -> Vocabulary:
    tokens, types = counts.agg(F.sum("c"), F.count("*")).first()
    top = common_words(counts, head).toArrow()
    top = sorted(zip(top.column(1).to_pylist(), top.column(0).to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    words, c = [w for _, w in top], np.array([n for n, _ in top], np.int64)
    spread = np.ones(buckets)
    for r in counts.groupBy((F.crc32("word") % buckets).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        spread[r["k"]] += r["c"] + r["n"]
    for w, n in zip(words[:own], c[:own], strict=True):
        spread[zlib.crc32(w) % buckets] -= n + 1
    return Vocabulary(b" ".join(words), c, spread, int(tokens or 0), types, own, buckets)


def _prepare(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """A row for each text: its classes, sums over its common words, and its rare words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    schema = "row long, doc_id long, held_out boolean, n_tokens long, classes binary, head_log double, head_known long, class_log double, rare array<struct<word:binary,n:int>>"
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        words, cls, log_spread = v.words(), v.classes(), np.log10(v.spread)
        log_c = np.log10(v.counts + 1.0)
        within = np.where(np.arange(len(cls)) < v.own, 0.0, log_c - log_spread[np.maximum(cls.astype(int) - v.own, 0)])
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b, out = whole.slice(at, 500), []
                for t in b.column(3).cast(pa.binary()):
                    tokens = words_of(t.as_py())
                    at_head = np.array([words.get(w, -1) for w in tokens])
                    known = at_head >= 0
                    head = at_head[known]
                    classes = np.empty(len(tokens), np.uint16)
                    classes[known] = cls[head]
                    rare_log, rare = 0.0, []
                    if len(head) < len(tokens):
                        tail = [tokens[k] for k in np.flatnonzero(~known)]
                        bucket = np.array([zlib.crc32(w) % v.buckets for w in tail])
                        classes[~known] = v.own + bucket
                        rare_log = -float(log_spread[bucket].sum())
                        rare = [{"word": w, "n": n} for w, n in Counter(tail).items()]
                    out.append((len(tokens), classes.tobytes(), float(log_c[head].sum()), len(head), float(within[head].sum()) + rare_log, rare))
                kinds = (pa.int64(), pa.binary(), pa.float64(), pa.int64(), pa.float64(), rare_type)
                new = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *new], [x.split()[0] for x in schema.split(", ")])

    held_out = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").cast("string"))
    return cut(rows.mapInArrow(run, schema), "lm-rows")


@dataclass
class Hmm:
    initial: np.ndarray
    transition: np.ndarray
    emission: np.ndarray  # class x state: p(class | state)


def first_guess(class_counts: np.ndarray, states: int = STATES, seed: int = SEED) -> Hmm:
    rng = np.random.default_rng(seed)
    e = (class_counts + SMOOTH)[:, None] * rng.gamma(1.0, size=(len(class_counts), states))
    a = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 if states > 1 else 1.0)
    return Hmm(np.full(states, 1 / states), a / a.sum(1, keepdims=True), e / e.sum(0))


def forward(hmm: Hmm, seqs: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of each sequence. Longest first."""
    log = np.zeros(len(seqs))
    lengths = np.array([len(s) for s in seqs])
    flat, start = np.concatenate(seqs).astype(np.int64), np.concatenate(([0], np.cumsum(lengths)[:-1]))
    alpha = None
    for t in range(lengths[0]):
        n = int(np.searchsorted(-lengths, -t, "left"))  # those longer than t come first
        e = hmm.emission[flat[start[:n] + t]]
        alpha = e * hmm.initial if alpha is None else (alpha[:n] @ hmm.transition) * e
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        log[:n] += np.log(scale)
    return log


def lanes_of(seqs: list[np.ndarray], blank: int) -> tuple[np.ndarray, np.ndarray]:
    """(steps x lanes of classes, whether a text starts): the sequences strung together in lanes of about one length.

    The rest of a lane is ``blank``, of which the first starts a text of its own.
    """
    total, longest = sum(map(len, seqs)), max(map(len, seqs))
    lanes = [(0, k, []) for k in range(max(1, min(LANES, len(seqs), -(-total // longest))))]
    for s in sorted(seqs, key=len, reverse=True):
        used, k, held = lanes[0]
        held.append(s)
        heapq.heapreplace(lanes, (used + len(s), k, held))
    steps = max(used for used, _, _ in lanes)
    seen, starts = np.full((steps, len(lanes)), blank, np.int32), np.zeros((steps, len(lanes)), bool)
    for n, (used, _, held) in enumerate(lanes):
        seen[:used, n] = np.concatenate(held) if held else 0
        at = np.cumsum([0, *map(len, held)])
        starts[at[at < steps], n] = True
    return seen, starts


def expected_counts(hmm: Hmm, seqs: list[np.ndarray]):
    """Initial, transition and class x state counts, and the log likelihood, over whole sequences."""
    blank, states = hmm.emission.shape
    emission = np.concatenate((hmm.emission, np.ones((1, states))))
    seen, starts = lanes_of(seqs, blank)
    steps, log = len(seen), 0.0

    def ahead(alpha, t):
        """The scaled states of step t and their scales."""
        alpha = np.where(starts[t][:, None], hmm.initial, alpha @ hmm.transition) * emission[seen[t]]
        scale = alpha.sum(1)
        return alpha / scale[:, None], scale

    alpha, kept = np.ones((seen.shape[1], states)), []
    for t in range(steps):
        if t % STRETCH == 0:
            kept.append(alpha)
        alpha, scale = ahead(alpha, t)
        log += float(np.log(scale)[seen[t] != blank].sum())
    initial, xi, counts = np.zeros(states), np.zeros((states, states)), np.zeros((blank + 1, states))
    beta = np.ones_like(alpha)
    for low in reversed(range(0, steps, STRETCH)):
        alphas, scales = [kept[low // STRETCH]], []
        for t in range(low, min(low + STRETCH, steps)):
            alpha, scale = ahead(alphas[-1], t)
            alphas.append(alpha)
            scales.append(scale)
        gammas = []
        for t in reversed(range(low, low + len(scales))):
            gamma = alphas[t - low + 1] * beta
            gammas.append(gamma)
            start = starts[t]
            initial += gamma[start & (seen[t] != blank)].sum(0)
            onward = emission[seen[t]] * beta / scales[t - low][:, None]
            onward[start | (seen[t] == blank)] = 0.0
            xi += alphas[t - low].T @ onward
            beta = np.where(start[:, None], 1.0, onward @ hmm.transition.T)
        classes, gamma = seen[low : low + len(scales)][::-1].ravel(), np.concatenate(gammas)
        for k in range(states):
            counts[:, k] += np.bincount(classes, gamma[:, k], blank + 1)
    return initial, xi * hmm.transition, counts[:blank], log


def _lanes(seqs: list[np.ndarray]) -> Iterator[list[int]]:
    order = sorted(range(len(seqs)), key=lambda k: -len(seqs[k]))
    for at in range(0, len(order), LANES):
        yield order[at : at + LANES]


def baum_welch_round(rows: DataFrame, hmm: Hmm) -> tuple[Hmm, float]:
    """One round over the column ``classes``: the sums over all partitions, then the new model and the old one's log likelihood."""
    spark, n = rows.sparkSession, hmm.emission.shape[1]
    shared = spark.sparkContext.broadcast(hmm)
    names = [f"s{k}" for k in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        initial, transition, emission, log = np.zeros(n), np.zeros((n, n)), np.zeros_like(m.emission), 0.0
        for b in batches:
            if b.num_rows:
                i, x, e, w = expected_counts(m, [np.frombuffer(c.as_py(), np.uint16) for c in b.column(0)])
                initial, transition, emission, log = initial + i, transition + x, emission + e, log + w
        used = np.flatnonzero(emission.sum(1))
        keys = np.concatenate((used, _TRANSITION - np.arange(n), [_INITIAL, _LIKELIHOOD]))
        values = np.concatenate((emission[used], transition, [initial], [np.r_[log, np.zeros(n - 1)]]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(values[:, k]) for k in range(n))], ["key", *names])

    parts = rows.select("classes").mapInArrow(run, "key int, " + ", ".join(f"{c} double" for c in names))
    sums = parts.groupBy("key").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    key = sums.column(0).to_numpy()
    value = np.stack([sums.column(1 + k).to_numpy() for k in range(n)], axis=1)
    emission = np.full_like(hmm.emission, SMOOTH)
    emission[key[key >= 0]] += value[key >= 0]
    transition = np.full((n, n), SMOOTH)
    for k in range(n):
        transition[k] += value[key == _TRANSITION - k].sum(0)
    initial = value[key == _INITIAL].sum(0) + SMOOTH
    hmm = Hmm(initial / initial.sum(), transition / transition.sum(1, keepdims=True), emission / emission.sum(0))
    return hmm, float(value[key == _LIKELIHOOD].sum())


def _forward_scores(rows: DataFrame, hmm: Hmm) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(hmm)
    plain = ["row", "doc_id", "held_out", "n_tokens", "head_log", "head_known", "class_log"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs, out = [np.frombuffer(x.as_py(), np.uint16) for x in b.column(len(plain))], np.zeros(b.num_rows)
            for some in _lanes(seqs):
                out[some] = forward(shared.value, [seqs[k] for k in some])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(plain)], pa.array(out / np.log(10.0))], [*plain, "path_log"])

    schema = "row long, doc_id long, held_out boolean, n_tokens long, head_log double, head_known long, class_log double, path_log double"
    return rows.select(*plain, "classes").mapInArrow(run, schema)


def score_texts(
    docs: DataFrame, rounds: int = ROUNDS, states: int = STATES, head: int = HEAD, own: int = OWN_CLASSES, buckets: int = BUCKETS
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    training = docs.filter(F.coalesce(crc_mod(F.col("doc_id"), FOLDS) != HELD, F.lit(True)))
    counts = cut(count_words(training), "lm-counts")
    vocab = vocabulary(counts, head, own, buckets)
    rows = _prepare(docs, vocab)
    hmm = first_guess(vocab.class_counts(), states)
    for _ in range(rounds if vocab.tokens else 0):
        hmm, _ = baum_welch_round(rows.filter("NOT held_out"), hmm)
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(counts, "word", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare_log"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"),
    )
    out = _forward_scores(rows, hmm).join(rare, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + rare_log - F.col("n_tokens") * F.log10(F.lit(float(vocab.tokens + vocab.types + 1)))).alias("base_score"),
        (F.col("path_log") + F.col("class_log") + rare_log).alias("score"),
    )
