import math

import numpy as np
import pytest
from conftest import DATA

from sheetwright.llm import permutation_index as P
from sheetwright.llm.common import table
from sheetwright.llm.queries import op1_permutation_index


def brute(data, k=5):
    """Exact neighbours of ids divisible by 50."""
    ok = [(i, np.array(v, float)) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in ok:
        if q % 50 == 0:
            near = [(-(v @ x) / np.sqrt(v @ v) / np.sqrt(x @ x), i) for i, v in ok if i != q and len(v) == len(x)]
            out.setdefault(q, sorted((round(s, 12), i) for s, i in near)[:k])
    return out


def test_edges(spark):
    rng = np.random.default_rng(3)
    v = lambda: rng.normal(size=6).tolist()
    hot = v()
    data = [(i, v()) for i in range(40)] + [(50 * i, hot) for i in range(1, 4)] + [(1000 + i, hot) for i in range(1, 40)]
    data += [(900, None), (901, [0.0] * 6), (902, [1.0, None] + [0.0] * 4), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (905, []), (None, v())]
    data += [(950, [1.0, 2.0]), (951, [2.0, 1.0]), (41, v()), (41, v())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    rows = P.usable(df)
    for group in (8_192, 2):
        got = {}
        for r in sorted(P.nearest_found(rows, rows.filter("id % 50 = 0"), group=group).collect(), key=lambda r: (r["query_id"], r["rank"])):
            got.setdefault(r["query_id"], []).append((round(-r["score"], 12), r["vec_id"]))
        assert got == brute(data)
    assert len(got[950]) == 1 and [i for _, i in got[50]] == [100, 150, 1001, 1002, 1003]


def test_empty_table(spark):
    rows = P.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert P.nearest_found(rows, rows).count() == 0


def test_footrule_counts_missing_pivots_as_past_the_end():
    rng = np.random.default_rng(4)
    lists = np.array([rng.permutation(12)[:6] for _ in range(30)] + [[20, 21, 22, 23, 24, 25]], np.int32)
    files = P.InvertedFiles.of(lists)
    place = lambda x: {p: k for k, p in enumerate(x)}
    for read in (1, 2, 3):
        for at in range(0, len(lists), P.ABREAST):
            some = lists[at : at + P.ABREAST, :read]
            nothing = sum(6 - k for k in range(read))
            want = {(i, j): nothing - sum(abs(k - place(x).get(p, 6)) for k, p in enumerate(q)) for i, q in enumerate(some) for j, x in enumerate(lists)}
            for least in (1, 6):
                got = files.nearer(some, np.full(len(some), least))
                assert dict(zip(zip(*(x.tolist() for x in got[:2])), got[2].tolist())) == {k: g for k, g in want.items() if g >= least}
    assert not any(map(len, files.nearer(np.array([[99, 98]]), np.ones(1))))


def test_files_hold_a_falling_share():
    """What a query's files hold grows far slower than the table, and vectors that aren't posted there are not touched."""
    rng, posted, touched = np.random.default_rng(5), [], []
    for n in (2_000, 20_000):
        x = rng.normal(size=(n, 64))
        pivots = P._unit(x[: math.ceil(P.PIVOT_ROOTS * math.sqrt(n))])
        files, q = P.InvertedFiles.of(P.orders(x, pivots)), P.orders(x[-P.ABREAST :], pivots)[:, : P.READ]
        size = np.diff(files.start)[np.searchsorted(files.pivot, q)]
        posted.append(size.sum() / P.ABREAST / n)
        touched.append(len(files.nearer(q, np.ones(P.ABREAST))[0]) / P.ABREAST / n)
    print(posted, touched)
    assert posted[1] < 0.4 * posted[0] and touched[1] < 0.65 * touched[0] and touched[1] < 0.6


def test_lists_name_the_nearest_pivots():
    rng = np.random.default_rng(2)
    x, pivots = rng.normal(size=(700, 9)), P._unit(rng.normal(size=(300, 9)))
    want = np.argsort(-(P._unit(x) @ pivots.T), axis=1, kind="stable")[:, : P.LIST]
    assert (P.orders(x, pivots) == want).all() and P.orders(x, pivots[:3]).shape == (700, 3)


def test_many_lengths_and_huge_and_tiny_components(spark):
    rng = np.random.default_rng(6)
    data = [(50 * n + k, rng.normal(size=n).tolist()) for n in range(1, 40) for k in range(3)]
    data += [(5000 + k, (rng.normal(size=5) * size).tolist()) for k, size in enumerate([1e200, 1e-200, 1e308, 5e-300] * 20)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    rows = P.usable(df)
    got = {}
    for r in sorted(P.nearest_found(rows, rows.filter("id % 50 = 0")).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((round(-r["score"], 12), r["vec_id"]))
    small = [(i, (np.array(v) / np.abs(v).max()).tolist()) for i, v in data]
    assert got == {q: near for q, near in brute(small).items() if near}


def test_answers_do_not_depend_on_the_deal(spark):
    rows = P.usable(table(spark, f"{DATA}/sf0.01", "embeddings"))
    queries, out = rows.filter("id % 50 = 0"), []
    for parts in (1, 7):
        dealt = rows.repartition(parts)
        out.append(sorted(tuple(r) for r in P.nearest_found(dealt, queries, sample=300).collect()))
    assert out[0] == out[1]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    data = [(r["vec_id"], r["embedding"]) for r in table(spark, f"{DATA}/{sf}", "embeddings").collect()]
    want = brute(data)
    got = {}
    for r in op1_permutation_index(spark, f"{DATA}/{sf}").collect():
        got.setdefault(r["query_id"], []).append(round(-r["score"], 12))
    hits = sum(sum(s <= w[-1][0] + 1e-9 for s in got[q]) for q, w in want.items())
    print(sf, hits / sum(map(len, want.values())))
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_recall_beside_many_copies_of_one_vector(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 64))
    x[rng.choice(3000, 1000, replace=False)] = rng.normal(size=64)
    data = [(k, v.tolist()) for k, v in enumerate(x)]
    rows, want, got = P.usable(spark.createDataFrame(data, "vec_id long, embedding array<double>")), brute(data), {}
    for r in P.nearest_found(rows, rows.filter("id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append(round(-r["score"], 12))
    hits = sum(sum(s <= w[-1][0] + 1e-9 for s in got[q]) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_repeated_ids_and_copies_keep_what_can_win():
    ids = np.array([7, 7, 7, 7, 7, 7, 1, 2, 3, 9, 9])
    x = np.array([[1.0, 2.0]] * 9 + [[2.0, 1.0]] * 2)
    pivots = P._unit(np.array([[1.0, 2.0], [2.0, 1.0]]))
    block = P.Block.read(P.Block.of(ids, x, pivots).row().to_pylist()[0])

    def near(some, k):
        q, best = np.array([[1.0, 2.0]] * len(some)), P.Best(len(some), k)
        P.search_block(block, P.Queries.of(np.array(some), q, P.Pivots(pivots, P.InvertedFiles.of(P.orders(x, pivots)), 99)), k, best)
        return [ids[scores > -np.inf].tolist() for ids, scores in zip(best.ids, best.scores)]

    assert near([7, 1, 50], 3) == [[1, 2, 3], [2, 3, 7], [1, 2, 3]]
    assert near([1], 7) == [[2, 3, 7, 7, 7, 7, 7]]
