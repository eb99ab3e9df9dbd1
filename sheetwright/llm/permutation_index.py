"""Approximate nearest neighbours by a permutation index.

Index: a vector is represented by its LIST nearest pivots, the nearest first. Blocks of
vectors are posted in inverted files, one a pivot, each with the vectors that list the pivot
and its place in their lists. Blocks are rows of a written table, made once: its distinct
vectors, their ids, and the postings in order of pivots. There are PIVOT_ROOTS * sqrt(n)
pivots for n distinct vectors (MAX_PIVOTS at most, which bounds what is broadcast), so files
get shorter, as a share of the table, while it grows.

Search: a query reads the files of its READ nearest pivots and ranks the vectors posted there by
the footrule distance, the sum of differences in place, where a pivot that a list lacks stands past
its end. Other vectors aren't touched: nothing is kept or compared for them. Candidates are the vectors within the
query's radius: the distance that holds CANDIDATE_ROOTS * sqrt(n) distinct vectors, read from
a sample of at most about SAMPLE distinct vectors, the whole table up to there. The radius is
one for the whole table, so answers don't depend on how the vectors are dealt into blocks.
Candidates are reranked by exact cosine in double precision. A task keeps its k best of each
query; these are merged.

A query's work: about READ * LIST / pivots postings a vector, so in all as sqrt(n) until MAX_PIVOTS binds (from
2^22 distinct vectors) and as n from there, READ look-ups a block, and as many cosines as candidates. Queries
meet the written blocks in groups of QUERY_GROUP, which bounds what is broadcast; a pass reads them once for a whole
group. Pivots and sample come from the distinct vectors with the least seeded hash; every vector is indexed, where it lies.

Edge cases: vectors null, zero or with null or non-finite components take no part, as
rows or queries; vectors meet only vectors of their own length, and each length has pivots
and radii of its own; components of any finite size give finite scores, as vectors are
first scaled by powers of two; copies of one vector fill no candidate places; rows that
repeat a vec_id are candidates of their own, but never for their own id; null ids take no part;
fewer than k candidates give fewer rows; only vec_id and embedding are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path

#: READ is at most half of LIST, so that a posting always brings a vector nearer.
LIST, READ, PIVOT_ROOTS, CANDIDATE_ROOTS, SEED = 96, 48, 32, 8, 42
MAX_PIVOTS, SAMPLE, QUERY_GROUP = 65_536, 65_536, 65_536
#: Components of the vectors of a sample or of a group of queries, about, at most; longer vectors make them smaller.
VALUES = 1 << 23
#: Rows and components of a block, at most; products of vectors and pivots made at once; queries that meet a block at once.
BLOCK, BLOCK_VALUES, TURN, ABREAST = 16_384, 1 << 20, 1 << 21, 16
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): the vectors that take part, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    return rows.filter(finite & F.exists("v", lambda x: x != 0))


@dataclass
class Pivots:
    """Of one length of vectors: unit pivots, the sample in inverted files, and the candidates that a query takes of it."""

    pivots: np.ndarray
    sample: InvertedFiles
    take: int


def fit(rows: DataFrame, seed: int = SEED, sample: int = SAMPLE) -> dict[int, Pivots]:
    """Pivots and samples by length of vectors. A part of all hash values is read, so copies count once."""
    n, length = rows.agg(F.count("*"), F.avg(F.size("v"))).first()
    share = min(1.0, min(sample, VALUES / (length or 1)) / max(1, n))
    h = F.xxhash64(F.lit(seed), "v").alias("h")
    some = rows.select(F.size("v").alias("n"), h, "v").filter(F.pmod("h", F.lit(1 << 32)) < int(share * (1 << 32)))
    got = some.groupBy("n", "h", "v").agg(F.lit(1)).select("n", "h", "v").orderBy("n", "h", "v").toArrow()
    size = got.column(0).to_numpy()
    flat, ends = pc.list_flatten(got.column(2)).to_numpy(), np.cumsum(size, dtype=np.int64)
    out = {}
    for n in np.unique(size).tolist():
        mine = np.flatnonzero(size == n)
        x = flat[(ends[mine] - n)[:, None] + np.arange(n)]
        root = math.sqrt(len(x) / share)
        pivots = _unit(x[: min(MAX_PIVOTS, math.ceil(PIVOT_ROOTS * root))])
        # Never fewer than LIST, so that a sparse sample still gives a radius that holds some.
        out[n] = Pivots(pivots, InvertedFiles.of(orders(x, pivots)), max(LIST, math.ceil(CANDIDATE_ROOTS * root * share)))
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """The vectors times powers of two, so that no square is too large or too small; this rounds nothing."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(-1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def orders(x: np.ndarray, pivots: np.ndarray, nearest: int = LIST) -> np.ndarray:
    """The nearest pivots of each vector, the nearest first; of pivots equally near (to 2**-40) the first."""
    n = len(pivots)
    nearest, out, turn = min(nearest, n), [], max(1, TURN // max(1, n))
    for at in range(0, len(x), turn):
        far = np.rint((_unit(x[at : at + turn]) @ pivots.T) * -(2.0**40)).astype(np.int64) * n + np.arange(n)
        if nearest < n:
            far = np.partition(far, nearest - 1, axis=1)[:, :nearest]
        out.append(np.sort(far, axis=1) % n)
    return np.concatenate(out).astype(np.int32) if out else np.zeros((0, nearest), np.int32)


class InvertedFiles:
    """Of one block: for each pivot the vectors that list it, and its place in their lists."""

    def __init__(self, n: int, length: int, pivot: np.ndarray, start: np.ndarray, vector: np.ndarray, place: np.ndarray):
        # The file of pivot[f] holds vector[start[f] : start[f + 1]]; pivots that no list names have none.
        self.n, self.length, self.pivot, self.start, self.vector, self.place = n, length, pivot, start, vector, place
        self._gain = self._last = np.zeros(0, np.int32)  # made at the first search; not broadcast

    @classmethod
    def of(cls, lists: np.ndarray) -> InvertedFiles:
        flat = lists.ravel()
        by = np.argsort(flat.astype(np.uint16) if len(flat) and flat.max() < 1 << 16 else flat, kind="stable")  # a radix sort
        pivot, start = np.unique(flat[by], return_index=True)
        vector, place = np.divmod(by, max(1, lists.shape[1]))
        return cls(*lists.shape, pivot.astype(np.int32), np.r_[start, len(by)].astype(np.int32), vector.astype(np.int32), place.astype(np.uint8))

    def nearer(self, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, gain) of vectors posted in the files of at most ABREAST queries (their pivots, the nearest first).

        The gain is how much less their footrule distance is than that of a list with none of the query's pivots; those
        with at least ``least`` (one a query) are returned. Only what is posted there is read, added or compared.
        """
        wanted = queries.ravel()
        at = np.flatnonzero(np.isin(wanted, self.pivot))
        f = np.searchsorted(self.pivot, wanted[at])
        low, size = self.start[f].astype(np.int64), (self.start[f + 1] - self.start[f]).astype(np.int64)
        rows = np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)
        query, place = (np.repeat(x, size) for x in np.divmod(at, max(1, queries.shape[1])))
        gain = (self.length - place - np.abs(self.place[rows] - place)).astype(np.int32)
        key = query * self.n + self.vector[rows]
        if not len(self._gain):
            self._gain, self._last = np.zeros(ABREAST * self.n, np.int32), np.zeros(ABREAST * self.n, np.int32)
        np.add.at(self._gain, key, gain)
        found = key[self._gain[key] >= least[query]]
        turn = np.arange(len(found), dtype=np.int32)
        self._last[found] = turn
        found = found[self._last[found] == turn]  # each once, still in order of queries
        out = self._gain[found]
        self._gain[key] = 0
        return found // max(1, self.n), found % max(1, self.n), out


@dataclass
class Block:
    """Distinct vectors in files; the rows of vector d have ids[start[d] : start[d + 1]], in order."""

    ids: np.ndarray
    start: np.ndarray
    vectors: np.ndarray
    files: InvertedFiles

    FIELDS = "n int, list int, ids binary, start binary, vectors binary, pivot binary, file binary, vector binary, place binary"

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray) -> Block:
        void = np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
        _, first, of = np.unique(void, return_index=True, return_inverse=True)
        order = np.lexsort((ids, of))
        start = np.searchsorted(of[order], np.arange(len(first) + 1)).astype(np.int32)
        return cls(ids[order], start, x[first], InvertedFiles.of(orders(x[first], pivots)))

    def row(self) -> pa.RecordBatch:
        f, names = self.files, [x.split()[0] for x in self.FIELDS.split(", ")]
        arrays = (self.ids, self.start, self.vectors, f.pivot, f.start, f.vector, f.place)
        numbers = [pa.array([v], pa.int32()) for v in (self.vectors.shape[1], f.length)]
        return pa.RecordBatch.from_arrays([*numbers, *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], names)

    @classmethod
    def read(cls, r: dict) -> Block:
        ids, vectors = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"], np.float64).reshape(-1, r["n"])
        start, pivot, file, vector = (np.frombuffer(r[c], np.int32) for c in ("start", "pivot", "file", "vector"))
        return cls(ids, start, vectors, InvertedFiles(len(vectors), r["list"], pivot, file, vector, np.frombuffer(r["place"], np.uint8)))

    def that_can_win(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, start) of the rows that can be among the k nearest of some query, where smaller ids go first:
        of each vector the k + 1 least ids (one may be the query's own), k rows of each."""
        of = np.repeat(np.arange(len(self.vectors)), np.diff(self.start))
        new_vector = np.diff(of, prepend=-1) != 0
        new_id = new_vector | np.r_[True, self.ids[1:] != self.ids[:-1]][: len(of)]
        at, nth_id = np.arange(len(of)), np.cumsum(new_id)
        row_of_id = at - np.maximum.accumulate(np.where(new_id, at, 0))
        nth_id = nth_id - np.maximum.accumulate(np.where(new_vector, nth_id, 0))
        kept = np.flatnonzero((row_of_id < k) & (nth_id <= k))
        return self.ids[kept], np.searchsorted(of[kept], np.arange(len(self.vectors) + 1))


def _ragged(start: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places start[d] : start[d + 1] of each d of ``of``, and which of ``of`` each belongs to."""
    low, size = start[of], start[of + 1] - start[of]
    return np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size), np.repeat(np.arange(len(of)), size)


@dataclass
class Queries:
    """Queries of one length of vectors, each with its nearest pivots and the gain that stands for its radius (0: all vectors)."""

    ids: np.ndarray
    vectors: np.ndarray
    lists: np.ndarray
    least: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray, fitted: Pivots) -> Queries:
        lists, least = orders(vectors, fitted.pivots)[:, :READ], np.zeros(len(ids), np.int32)
        if fitted.take < fitted.sample.n:  # the query's own vector is one more
            for at in range(0, len(ids), ABREAST):
                some = lists[at : at + ABREAST]
                query, _, gain = fitted.sample.nearer(some, np.ones(len(some), np.int32))
                for k, mine in enumerate(np.split(gain, np.searchsorted(query, np.arange(1, len(some))))):
                    # fewer posted than that: all that are posted, and each pivot read is one of them
                    least[at + k] = np.partition(mine, -fitted.take - 1)[-fitted.take - 1] if len(mine) > fitted.take else 1
        return cls(ids, vectors, lists, least)


class Best:
    """The k best found for each query: ids and scores, the best first, ties to smaller ids."""

    def __init__(self, queries: int, k: int):
        self.ids, self.scores = np.full((queries, k), np.iinfo(np.int64).max), np.full((queries, k), -np.inf)

    def merge(self, low: int, high: int, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge what is found for queries low to high; ``query`` counts from low."""
        k = self.ids.shape[1]
        query = np.concatenate((np.repeat(np.arange(high - low), k), query))
        ids, scores = np.concatenate((self.ids[low:high].ravel(), ids)), np.concatenate((self.scores[low:high].ravel(), scores))
        order = np.lexsort((ids, -scores, query))
        first = np.searchsorted(query[order], np.arange(high - low))
        kept = order[(first[:, None] + np.arange(k)).ravel()]
        self.ids[low:high], self.scores[low:high] = ids[kept].reshape(-1, k), scores[kept].reshape(-1, k)


def search_block(block: Block, queries: Queries, k: int, best: Best) -> None:
    """Merge what a block holds for the queries into best."""
    ids, start = block.that_can_win(k)
    x = _scaled(block.vectors)
    norm = np.sqrt((x * x).sum(1))
    for low in range(0, len(queries.ids), ABREAST):
        high = min(low + ABREAST, len(queries.ids))
        query, vector, _ = block.files.nearer(queries.lists[low:high], np.maximum(queries.least[low:high], 1))
        whole = np.flatnonzero(queries.least[low:high] == 0)
        if len(whole):  # of a length of vectors with no more than take distinct ones in all
            other = ~np.isin(query, whole)
            query = np.concatenate((query[other], np.repeat(whole, len(x))))
            vector = np.concatenate((vector[other], np.tile(np.arange(len(x)), len(whole))))
        q = _scaled(queries.vectors[low:high])
        score = (x[vector] * q[query]).sum(1) / (norm[vector] * np.sqrt((q * q).sum(1))[query])
        rows, of = _ragged(start, vector)
        other = ids[rows] != queries.ids[low:high][query[of]]
        rows, of = rows[other], of[other]
        best.merge(low, high, query[of], ids[rows], score[of])


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, rows, vectors) of each length of the vectors in column 1."""
    size = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
    ends, flat = np.cumsum(size), b.column(1).flatten().to_numpy()
    for n in np.unique(size).tolist():
        mine = np.flatnonzero(size == n)
        yield n, mine, flat[(ends[mine] - n)[:, None] + np.arange(n)]


def index(rows: DataFrame, fitted: dict[int, Pivots]) -> DataFrame:
    """Every row (id, v) in a block with its inverted files, written."""
    shared = rows.sparkSession.sparkContext.broadcast({n: f.pivots for n, f in fitted.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for n, mine, x in _by_length(b):
                turn = max(1, min(BLOCK, BLOCK_VALUES // n))
                for at in range(0, len(mine), turn):
                    pivots = shared.value.get(n, np.zeros((0, n)))
                    yield Block.of(ids[mine[at : at + turn]], x[at : at + turn], pivots).row()

    return cut(rows.select("id", "v").mapInArrow(run, Block.FIELDS), "permutations")


def nearest_found(rows: DataFrame, queries: DataFrame, k: int = 5, group: int = QUERY_GROUP, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (id, v) the k nearest found among rows (id, v), but its own id."""
    spark = rows.sparkSession
    fitted = fit(rows, sample=sample)
    indexed = index(rows, fitted)
    n, values = queries.agg(F.count("*"), F.sum(F.size("v"))).first()
    groups = max(1, -(-n // group), -(-(values or 0) // VALUES))
    grouped = cut(queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")), "knn-queries", partition_by="part")
    whole = spark.sparkContext.broadcast(fitted)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n", "ids", "vectors", "lists", "least"]
        for b in batches:
            for n, mine, x in _by_length(b):
                ids = b.column(0).to_numpy()[mine]
                nothing = Pivots(np.zeros((0, n)), InvertedFiles.of(np.zeros((0, 0), np.int32)), 0)
                q = Queries.of(ids, x, whole.value.get(n, nothing))
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (n, ids.tobytes(), x.tobytes(), q.lists.tobytes(), q.least.tobytes())], names)

    def search(part: DataFrame):
        ready: dict[int, list] = {}
        for r in part.select("id", "v").mapInArrow(prepare, "n long, ids binary, vectors binary, lists binary, least binary").collect():
            ready.setdefault(r["n"], []).append(r)
        held = {}
        for n, some in ready.items():
            of = lambda c, kind, some=some: np.concatenate([np.frombuffer(r[c], kind) for r in some])
            ids = of("ids", np.int64)
            held[n] = Queries(ids, of("vectors", np.float64).reshape(-1, n), of("lists", np.int32).reshape(len(ids), -1), of("least", np.int32))
        shared = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, Best] = {}
            for b in batches:
                for at in range(b.num_rows):
                    r = b.slice(at, 1).to_pylist()[0]
                    if (n := r["n"]) in shared.value:
                        search_block(Block.read(r), shared.value[n], k, best.setdefault(n, Best(len(shared.value[n].ids), k)))
            for n, found in best.items():
                q, _ = np.nonzero(real := found.scores > -np.inf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shared.value[n].ids[q]), pa.array(found.ids[real]), pa.array(found.scores[real])], ["query_id", "vec_id", "score"]
                )

        return indexed.mapInArrow(run, FOUND), shared

    if groups == 1:
        found = search(grouped)[0]
    else:  # one group's queries are held at a time; what each has found is kept in the shared folder
        path = fresh_path(spark, "knn-found")
        for g in range(groups):
            part, held = search(grouped.filter(F.col("part") == g))
            part.write.mode("append").parquet(path)
            held.destroy()
        found = spark.read.schema(FOUND).parquet(path)
    over = "PARTITION BY query_id ORDER BY score DESC, vec_id"
    found = found.withColumn("rank", F.expr(f"row_number() OVER ({over})").cast("int")).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
