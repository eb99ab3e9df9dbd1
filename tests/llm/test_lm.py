import itertools
import math
import zlib
from collections import Counter

import numpy as np
from edge import documents, empty

from sheetwright.llm import hmm_lm as H


def slow_forward(hmm, seq):
    """Likelihood by summing over all paths."""
    n = len(hmm.initial)
    total = 0.0
    for path in itertools.product(range(n), repeat=len(seq)):
        p = hmm.initial[path[0]] * hmm.emission[seq[0], path[0]]
        for a, b, x in zip(path, path[1:], seq[1:], strict=False):
            p *= hmm.transition[a, b] * hmm.emission[x, b]
        total += p
    return total


def test_forward_and_counts():
    hmm = H.first_guess(np.arange(1.0, 6.0), states=3)
    seqs = [np.array(s, np.uint16) for s in ([0, 1, 2, 3], [4, 4, 1], [2, 2, 0], [3])]
    assert np.allclose(np.exp(H.forward(hmm, seqs)), [slow_forward(hmm, s) for s in seqs])
    total = sum(math.exp(H.forward(hmm, [np.array(s, np.uint16)])[0]) for s in itertools.product(range(5), repeat=2))
    assert abs(total - 1) < 1e-9
    initial, transition, emission, _ = H.expected_counts(hmm, seqs)
    assert abs(initial.sum() - 4) < 1e-9 and abs(transition.sum() - 7) < 1e-9
    assert np.allclose(emission.sum(1), np.bincount(np.concatenate(seqs), minlength=5))
    # each state's share by brute force, on one sequence
    seq = seqs[1]
    want = np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=3):
        p = hmm.initial[path[0]] * hmm.emission[seq[0], path[0]]
        for a, b, x in zip(path, path[1:], seq[1:], strict=False):
            p *= hmm.transition[a, b] * hmm.emission[x, b]
        for s, x in zip(path, seq, strict=True):
            want[x, s] += p / slow_forward(hmm, seq)
    assert np.allclose(H.expected_counts(hmm, [seq])[2], want)


def slow_counts(hmm, seq):
    """Transition and emission counts of one sequence by unscaled forward and backward sums."""
    n, a, e = len(seq), hmm.transition, hmm.emission
    f, b = np.zeros((n, len(a))), np.ones((n, len(a)))
    for t in range(n):
        f[t] = (f[t - 1] @ a if t else hmm.initial) * e[seq[t]]
    for t in reversed(range(n - 1)):
        b[t] = a @ (e[seq[t + 1]] * b[t + 1])
    p, counts = f[-1].sum(), np.zeros_like(e)
    for t in range(n):
        counts[seq[t]] += f[t] * b[t] / p
    return sum((np.outer(f[t], e[seq[t + 1]] * b[t + 1]) * a / p for t in range(n - 1)), np.zeros_like(a)), counts, f[0] * b[0] / p, math.log(p)


def test_lanes_of_whole_sequences(monkeypatch):
    """Lanes with many texts, and stretches shorter than a text, count as each whole text alone does."""
    rng = np.random.default_rng(4)
    hmm = H.first_guess(rng.random(9) + 0.1, states=3)
    seqs = [rng.integers(0, 9, k).astype(np.uint16) for k in (1, 90, 2, 33, 1, 7, 64, 20, 5)]
    want = [slow_counts(hmm, s) for s in seqs]
    for lanes, stretch in ((512, 256), (2, 8), (3, 1), (1, 13)):
        monkeypatch.setattr(H, "LANES", lanes)
        monkeypatch.setattr(H, "STRETCH", stretch)
        initial, transition, emission, log = H.expected_counts(hmm, seqs)
        assert np.allclose(transition, sum(w[0] for w in want)) and np.allclose(emission, sum(w[1] for w in want))
        assert np.allclose(initial, sum(w[2] for w in want)) and abs(log - sum(w[3] for w in want)) < 1e-6


def test_common_words_are_the_commonest(spark):
    rng = np.random.default_rng(9)
    c = {f"w{k}": int(x) for k, x in enumerate(rng.zipf(1.3, 4000).clip(1, 10**9))}
    counts = spark.createDataFrame([(w.encode(), n) for w, n in c.items()], "word binary, c long")
    for limit in (10, 300, 1500, 5000):
        got = {r["word"].decode(): r["c"] for r in H.common_words(counts, limit).collect()}
        left = max((n for w, n in c.items() if w not in got), default=0)
        assert 0.8 * min(limit, 4000) <= len(got) <= limit * 1.1 + 10 and min(got.values()) >= left * (1 - 1 / 1000)


def test_scores_of_edge_cases(spark, monkeypatch):
    logs, one = [], H.baum_welch_round

    def watched(rows, hmm):
        new, log = one(rows, hmm)
        logs.append(log)
        return new, log

    monkeypatch.setattr(H, "baum_welch_round", watched)
    docs = documents(spark)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    counts = Counter(w for i, t in texts if not held[i] for w in H.words_of((t or "").encode()))
    n, v = sum(counts.values()), len(counts)
    got = H.score_texts(docs, head=12, own=6, buckets=5).collect()
    assert len(got) == len(texts)
    plain = sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got)
    want = []
    for i, t in texts:
        w = H.words_of((t or "").encode())
        want.append((repr(i), held[i], len(w), sum(x in counts for x in w), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)))
    assert plain == sorted(want) and {r["train_tokens"] for r in got} == {n}
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert logs == sorted(logs) and len(logs) == H.ROUNDS


def test_empty_tables(spark):
    assert H.score_texts(empty(spark)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    alone = empty(spark).unionByName(spark.createDataFrame([(held, "some words", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    r = H.score_texts(alone).first()
    assert (r["train_tokens"], r["n_tokens"], r["n_known"], r["base_score"]) == (0, 3, 0, 0.0)


def test_model_beats_the_base_on_held_out_texts(spark):
    from conftest import DATA

    from sheetwright.llm.queries import op2_hmm_lm

    r = op2_hmm_lm(spark, f"{DATA}/sf0.01").filter("held_out").groupBy().sum("base_score", "score").first()
    print(r["sum(score)"] / r["sum(base_score)"])
    assert r["sum(score)"] > r["sum(base_score)"] * 0.97
