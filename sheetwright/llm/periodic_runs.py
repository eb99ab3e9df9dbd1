"""Periodic runs of words: whole texts compressed by Re-Pair, runs found at the boundaries of its nonterminals.

A run is a stretch of words with smallest period q, at least max(6, 4 q) words long, that can't be
extended. The word ids of a group of documents are compressed by Re-Pair: pairs that occur twice or
more become nonterminals, most frequent first, until no pair repeats; what is left of each document
is then joined two by two, so a document is one symbol. A run lies in the text of
some nonterminal and crosses the boundary between its two parts, so runs are computed once for
each nonterminal, at its first place, carried to all places of its derivation, and
overlapping stretches of one period are merged into maximal ones.

Re-Pair goes in rounds over numpy arrays: a round replaces every pair that is of a higher class of
frequency (its power of two; ties by a hash) than the pairs that overlap it. For a nonterminal of s words
the periods up to s / 4 are tried: a run of four periods has two of them on one side of the
boundary, so equal words one period apart are asked for at three places there, and only what is left is
extended word by word within the nonterminal. All comparisons are of ids, so nothing is approximate.

Edge cases: null, empty and blank texts have no words and no runs, and collapse to the empty text; each
row gives one row, repeated rows alike; very long texts are a group of their own; only the text
column is read, the input's columns are kept in the struct ``doc``; an empty table gives none.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least number of words of a run, and of its periods.
LEAST, TIMES = 6, 4
#: Words that are compressed together, where no single text is longer.
GROUP_WORDS = 400_000
#: (nonterminal, period) pairs that are tried at once.
TRIES = 2_000_000


class Grammar:
    """Re-Pair of the word ids of documents, cut at ``starts`` (the first word of each document that has words).

    Of each nonterminal: ``first`` (where it first stands), ``left`` and ``size`` (words of its left part and in
    all). ``symbols`` and ``places`` list all nonterminals of all derivations.
    """

    def __init__(self, ids: np.ndarray, starts: np.ndarray):
        self.sym, self.pos, self.words = ids.astype(np.int64), np.arange(len(ids)), np.ones(len(ids), np.int64)
        self.last = np.zeros(len(ids), bool)
        self.last[np.append(starts[1:], len(ids)) - 1] = True
        self.terminals = self.next = int(ids.max()) + 1
        self.lone = np.zeros(len(ids), bool)  # this and the next symbol are a pair that occurs once
        parts, used = [], []
        while (taken := self._repeated()) is not None:
            parts.append(self._replace(*taken)), used.append((self.sym[self.new], self.pos[self.new]))
        while (taken := self._neighbours()) is not None:
            parts.append(self._replace(*taken)), used.append((self.sym[self.new], self.pos[self.new]))
        join = lambda of, i: np.concatenate([x[i] for x in of]) if of else np.zeros(0, np.int64)
        self.first, self.left, self.size = (join(parts, i) for i in range(3))
        self.symbols, self.places = join(used, 0) - self.terminals, join(used, 1)

    def _repeated(self):
        """Places of the pairs to replace in this round, and the kind of each; None where no pair repeats."""
        live = np.flatnonzero(~(self.last | self.lone)[:-1]) if len(self.sym) > 1 else np.zeros(0, np.int64)
        if not len(live):
            return None
        _, kind, times = np.unique(self.sym[live] * self.next + self.sym[live + 1], return_inverse=True, return_counts=True)
        often = times[kind]
        self.lone[live[often == 1]] = True
        live, kind, often = live[often > 1], kind[often > 1], often[often > 1]
        if not len(live):
            return None
        mixed = (kind.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(8)
        rank = np.zeros(len(self.sym) - 1, np.int64)
        rank[live] = (np.frexp(often.astype(float))[1].astype(np.int64) << 56) + mixed.astype(np.int64)
        kinds = np.zeros(len(rank), np.int64)
        kinds[live] = kind
        edge = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))  # stretches of one pair, such as x x x x
        of, long = rank[edge], np.diff(np.append(edge, len(rank)))
        high = (of > np.append(0, of[:-1])) & (of > np.append(of[1:], 0))
        at = np.flatnonzero(np.repeat(high, long) & ((np.arange(len(rank)) - np.repeat(edge, long)) % 2 == 0))
        return at, kinds[at]

    def _neighbours(self):
        """Every second symbol of each document with its neighbour; None where each document is one symbol."""
        if self.last.all():
            return None
        head = np.flatnonzero(np.append(True, self.last[:-1]))
        nth = np.arange(len(self.sym)) - np.repeat(head, np.diff(np.append(head, len(self.sym))))
        at = np.flatnonzero((nth % 2 == 0) & ~self.last)
        return at, np.arange(len(at))

    def _replace(self, at: np.ndarray, kind: np.ndarray):
        """Put a nonterminal for each kind of pair in its places; returns first, left and size of the new ones."""
        _, one, name = np.unique(kind, return_index=True, return_inverse=True)  # index of the first, which is leftmost
        made = self.pos[at[one]], self.words[at[one]], self.words[at[one]] + self.words[at[one] + 1]
        self.sym[at] = self.next + name
        self.words[at] += self.words[at + 1]
        self.last[at] = self.last[at + 1]
        self.lone[at] = False
        self.lone[at[at > 0] - 1] = False
        keep = np.ones(len(self.sym), bool)
        keep[at + 1] = False
        self.new = at - np.arange(len(at))  # one symbol is gone for each pair before it
        self.sym, self.pos, self.words, self.last, self.lone = (x[keep] for x in (self.sym, self.pos, self.words, self.last, self.lone))
        self.next += len(one)
        return made


def crossing(ids: np.ndarray, first: np.ndarray, left: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows (nonterminal, start, stop, period) of the runs over each nonterminal's boundary, within it."""
    able = np.flatnonzero(size >= LEAST)
    tries = np.cumsum(size[able] // TIMES)
    out = []
    for lo, hi in _chunks(tries):
        node = np.repeat(able[lo:hi], size[able[lo:hi]] // TIMES)
        ends = np.cumsum(size[able[lo:hi]] // TIMES)
        q = np.arange(len(node)) - np.repeat(np.append(0, ends[:-1]), size[able[lo:hi]] // TIMES) + 1
        b, half = first[node] + left[node], np.maximum((LEAST + 1) // 2, TIMES // 2 * q)
        # Most of the run is right of the boundary: words b-1, b, ... equal those a period on; or left of it.
        for right in (True, False):
            room = half <= size[node] - left[node] if right else half <= left[node]
            i = np.flatnonzero(room)
            for at in ((b - 1, b, b + half - q - 1) if right else (b - q, b - q - 1, b - half)):
                x = at[i]
                i = i[ids[x] == ids[x + q[i]]]
            out += [_extended(ids, int(v), first, size, int(b[k] - 1 if right else b[k] - q[k]), int(q[k])) for k, v in zip(i, node[i])]
    found = np.array([x for x in out if x], np.int64).reshape(-1, 4)
    found = found[np.lexsort(found.T[[3, 2, 1, 0]])] if len(found) else found
    # A stretch with several periods has the smallest, which divides the others.
    return found[np.append(True, (found[1:, :3] != found[:-1, :3]).any(1))[: len(found)]]


def _chunks(tries: np.ndarray):
    lo = 0
    while lo < len(tries):
        hi = max(lo + 1, int(np.searchsorted(tries, (tries[lo - 1] if lo else 0) + TRIES, "right")))
        yield lo, hi
        lo = hi


def _extended(ids, node, first, size, at, q):
    """The stretch of period q around the equal words at ``at`` and ``at + q`` in the nonterminal, if it is a run."""
    lo, hi = int(first[node]), int(first[node] + size[node])
    same = ids[lo : hi - q] == ids[lo + q : hi]
    k = at - lo
    back, ahead = same[k::-1], same[k:]
    start = lo if back.all() else at - int(back.argmin()) + 1
    stop = hi if ahead.all() else at + int(ahead.argmin()) + q
    return (node, start, stop, q) if stop - start >= max(LEAST, TIMES * q) else None


def runs_of(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows (start, stop, period) of all maximal runs in documents of word ids, by start, then period."""
    none = np.zeros((0, 3), np.int64)
    if not len(ids):
        return none
    g = Grammar(ids, starts)
    found = crossing(ids, g.first, g.left, g.size)
    if not len(found):
        return none
    at = np.flatnonzero(np.isin(g.symbols, found[:, 0]))
    at = at[np.argsort(g.symbols[at], kind="stable")]
    lo, hi = (np.searchsorted(g.symbols[at], found[:, 0], side) for side in ("left", "right"))
    of = np.repeat(np.arange(len(found)), hi - lo)
    place = g.places[at[np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]]
    moved = place - g.first[found[of, 0]]
    start, stop, q = found[of, 1] + moved, found[of, 2] + moved, found[of, 3]
    order = np.lexsort((stop, start, q))
    start, stop, q = start[order], stop[order], q[order]
    apart = q * (2 * len(ids) + 2)
    reach = np.maximum.accumulate(apart + stop)
    new = np.flatnonzero(np.append(True, (apart + start + q)[1:] > reach[:-1]))  # runs of one period share less than it
    runs = np.column_stack([start[new], np.maximum.reduceat(stop, new), q[new]])
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _groups(sizes: list[int]):
    lo, total = 0, 0
    for k, n in enumerate(sizes):
        if k > lo and total + n > GROUP_WORDS:
            yield lo, k
            lo, total = k, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def find_in_texts(texts: list[bytes | None]) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text: its runs (start, length, period), and its kept words joined by blanks."""
    out = []
    for lo, hi in _groups([len(t or b"") // 6 for t in texts]):
        words = [(t or b"").split() for t in texts[lo:hi]]  # bytes are split at ASCII white space
        number = defaultdict(count().__next__)
        sizes = np.array([len(w) for w in words], np.int64)
        ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        runs = runs_of(ids, starts[sizes > 0])
        step = np.zeros(len(ids) + 1, np.int64)
        np.add.at(step, runs[:, 0] + runs[:, 2], 1)
        np.add.at(step, runs[:, 1], -1)
        keep = np.cumsum(step)[:-1] == 0
        which = np.searchsorted(starts, runs[:, 0], "right") - 1
        cut = np.searchsorted(which, np.arange(len(words) + 1))
        for k, ws in enumerate(words):
            some = runs[cut[k] : cut[k + 1]]
            if len(some):
                ws = compress(ws, keep[starts[k] : starts[k] + sizes[k]].tolist())
            out.append(([(int(s - starts[k]), int(e - s), int(q)) for s, e, q in some], b" ".join(ws)))
    return out


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(text: pa.Array) -> pa.Array:
    found = find_in_texts(text.cast(pa.large_binary()).to_pylist())
    runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs, _ in found], pa.list_(_RUN))
    return pa.StructArray.from_arrays([runs, pa.array([t for _, t in found], pa.binary()).view(pa.string())], ["runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc (the input row), runs (array of start, length, period, by start, then period), collapsed (the text without
    what repeats: of each run its first period stays, words joined by one blank)."""
    found = F.arrow_udf(_found, "struct<runs: array<struct<start: long, length: long, period: long>>, collapsed: string>")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("text").alias("body"))
    return rows.withColumn("found", found("body")).select("doc", "found.runs", "found.collapsed")
