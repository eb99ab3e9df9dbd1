import itertools

from conftest import DATA, rows
from edge import documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import same

from sheetwright.llm import mixing as M
from sheetwright.llm.queries import ORACLES, op3_mix_sources


def test_targets():
    assert M.capped_targets([100, 100, 100], [3, 1, 2], 450) == [200.0, 250 / 3, 500 / 3]
    assert M.capped_targets([0, 10], [3, 1], 15) == [0.0, 15.0]
    assert M.capped_targets([], [], 0) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.sampled_from("ab"), min_size=1), st.integers(0, 3)), min_size=1, max_size=3), st.integers(0, 5), st.integers(0, 5))
def test_flow_is_largest_and_cheapest(patterns, qa, qb):
    patterns = [(frozenset(p), t) for p, t in patterns]

    def cost(flow):
        return sum(k * k for f, (_, t) in zip(flow, patterns, strict=True) for k in (u // t for u in range(f)))

    best = None
    for flow in itertools.product(*(range(2 * t + 1) for _, t in patterns)):
        for to_a in itertools.product(*(range(f + 1) for f in flow)):
            a, b = sum(to_a), sum(flow) - sum(to_a)
            if a > qa or b > qb or any((x and "a" not in p) or (f - x and "b" not in p) for x, f, (p, _) in zip(to_a, flow, patterns, strict=True)):
                continue
            key = (-sum(flow), cost(flow))
            best = min(best or key, key)
    got = M.min_cost_flow(patterns, {"a": qa, "b": qb}, 2)
    assert (-sum(got), cost(got)) == best


def test_query(spark):
    assert same(op3_mix_sources(spark, f"{DATA}/sf0.001"), ORACLES["op3_mix_sources"], f"{DATA}/sf0.001") == 200


def test_mix_is_near_its_targets_and_reruns_agree(spark):
    first = op3_mix_sources(spark, f"{DATA}/sf0.01")
    assert rows(first) == rows(op3_mix_sources(spark, f"{DATA}/sf0.01"))
    by = {}
    for r in first.collect():
        by.setdefault((r["source_size"], r["target"]), []).append(r)
        assert r["taken"] <= 2 * r["size"]
    for (_, target), x in by.items():
        assert abs(sum(r["taken"] for r in x) - target) <= max(r["size"] for r in x)


def test_edges(spark):
    docs = documents(spark)
    got = M.mix_sources(docs).collect()
    assert len(got) == docs.count() and {r["doc"]["p"] for r in got} == {"clash"}
    assert {r["size"] for r in got if r["doc"]["doc_id"] in (0, 1, 2)} == {0}
    assert M.mix_sources(empty(spark)).count() == 0


def test_overlapping_sources(spark):
    data = [(k, "w " * 10, ["a"] if k < 10 else ["b"] if k < 12 else ["b", "a"]) for k in range(40)]
    docs = spark.createDataFrame(data, "doc_id long, text string, of array<string>")
    got = M.mix_sources(docs, weights=(1, 1), budget_share=0.5, sources="of").collect()
    # a holds 380 words, b 300; half of all (400) words: 100 each, and no text need repeat
    assert sum(r["taken"] for r in got) == 200 and {r["n_copies"] for r in got} == {0, 1}
    assert {r["source_size"] for r in got if len(r["doc"]["of"]) == 2} == {680}


def test_networks_of_linked_sources(spark):
    """Networks by themselves, one of three linked sources, null and empty memberships: as one flow over all patterns."""
    import random

    rng = random.Random(5)
    of = [["a"], ["b", "a"], ["b", "c"], ["d"], [None], ["e", None], [], None, ["f"]]
    data = [(k, "w " * rng.randint(0, 9), of[rng.randrange(len(of))]) for k in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string, of array<string>")
    got = M.mix_sources(docs, sources="of").collect()
    assert len(got) == len(data)
    size, names = {}, sorted({s for _, _, x in data for s in x or []}, key=lambda s: (s is None, s or ""))
    for _, t, x in data:
        p = frozenset(x or [])
        size[p] = size.get(p, 0) + len(t.split())
    patterns = sorted(size.items(), key=lambda x: sorted(names.index(s) for s in x[0]))
    own = {s: sum(n for p, n in patterns if s in p) for s in names}
    target = dict(zip(names, M.capped_targets([own[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5 * sum(size.values())), strict=True))
    flow = dict(zip((p for p, _ in patterns), M.min_cost_flow(patterns, {s: int(t + 0.5) for s, t in target.items()}, 2), strict=True))
    taken, most = {}, {}
    for r in got:
        p = frozenset(r["doc"]["of"] or [])
        taken[p] = taken.get(p, 0) + r["taken"]
        most[p] = max(most.get(p, 0), r["size"])
        assert abs(r["target"] - sum(target[s] for s in p)) < 1e-9 and r["source_size"] == sum(own[s] for s in p)
    assert sum(taken.values()) <= sum(flow.values()) + sum(most.values())
    for p in ({"d"}, {"f"}, set()):  # alone in their networks, so their flow is the only one
        assert abs(taken.get(frozenset(p), 0) - flow.get(frozenset(p), 0)) <= most.get(frozenset(p), 0)
    for net in ({"a", "b", "c"}, {"e", None}):
        some = [p for p in flow if p & net]
        assert abs(sum(taken[p] for p in some) - sum(flow[p] for p in some)) <= sum(most[p] for p in some)


def test_many_sources_and_one_network_too_large(spark):
    import pytest

    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id) AS source", "'a b c d' AS text")
    got = M.mix_sources(docs, most=10).groupBy("target").agg({"taken": "sum", "*": "count"}).collect()
    assert sum(r["count(1)"] for r in got) == 3000 and len(got) == 3
    linked = spark.createDataFrame([(k, "a b", [f"s{k}", f"s{k + 1}"]) for k in range(30)], "doc_id long, text string, of array<string>")
    with pytest.raises(Exception, match="more than 10 patterns"):
        M.mix_sources(linked, sources="of", most=10).collect()
