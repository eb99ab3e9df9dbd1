import random
from itertools import combinations

from conftest import DATA
from edge import documents
from pyspark.sql import functions as F

import corpus_pipeline as C
from sheetwright.llm import near_copies as N
from sheetwright.llm.common import cut, table


def slow_groups(rows, similarity=0.8):
    """{row: least row of its component} of (row, text), by all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    of = {i: i for i in sets}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or (min(len(x), len(y)) >= similarity * max(len(x), len(y)) and len(x & y) >= similarity * len(x | y)):
            p, q = sorted((root(a), root(b)))
            of[q] = p
    return {i: root(i) for i in sets}


def planted(seed=3):
    """Pairs with some words changed, at similarities about 0.7 to 0.97, and texts of their own."""
    rng, out = random.Random(seed), []
    for _ in range(60):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(150, 300))]
        out.append(" ".join(words))
        for k in rng.sample(range(len(words)), rng.randint(1, 9)):
            words[k] = f"x{rng.randrange(4000)}"
        out.append(" ".join(words))
    return out


def test_planted_pairs_stay_once(spark):
    """The stage keeps the first text of each pair at 0.8 or more, and both of each pair below."""
    texts = planted()
    of = slow_groups(enumerate(texts))
    at = [N.jaccard(N.shingle_set(texts[k].encode()), N.shingle_set(texts[k + 1].encode())) for k in range(0, len(texts), 2)]
    assert sum(0.8 <= x < 0.85 for x in at) > 2 and sum(0.85 <= x < 0.95 for x in at) > 5 and sum(x < 0.8 for x in at) > 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in C.near_copies(spark, docs, "").collect()}
    assert got == set(of.values()) and len(got) < len(texts) - 20


def test_groups_of_tables(spark):
    """All groups as by all pairs, in a table with nulls and ties and in the smallest one."""
    for df in (documents(spark), table(spark, f"{DATA}/sf0.001", "documents")):
        df = cut(df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
        rows = df.collect()
        of = slow_groups([(r["row"], r["text"]) for r in rows])
        least = {}
        for r in rows:
            if r["doc_id"] is not None:
                least[of[r["row"]]] = min(least.get(of[r["row"]], r["doc_id"]), r["doc_id"])
        got = {r["row"]: (r["doc_id"], r["component_id"]) for r in N.near_copies(df).collect()}
        assert got == {r["row"]: (r["doc_id"], least.get(of[r["row"]])) for r in rows}


def test_one_large_bucket(spark):
    """Chains and stars of near copies that share one long passage: no link between components is left out."""
    rng = random.Random(8)
    common = [f"c{k}" for k in range(120)]
    texts = []
    for _ in range(150):
        words = list(common)
        for k in rng.sample(range(120), rng.randint(0, 4)):
            words[k] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(words + [f"z{rng.randrange(10**6)}" for _ in range(rng.choice((0, 5, 30)))]))
    of = slow_groups(enumerate(texts))
    docs = cut(spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row long, doc_id long, text string"), "rows")
    for chunk in (40, 1024):
        assert {r["row"]: r["component_id"] for r in N.near_copies(docs, chunk=chunk).collect()} == of


def test_one_row_of_each_group(spark):
    """Repeated ids and rows, a repeated id with another text, and null ids: the stage decides by row."""
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "a text that only rows without ids have")
    data = [(1, a), (1, a), (2, a), (None, a), (1, b), (0, b), (None, b), (None, c), (None, c)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((tuple(r) for r in C.near_copies(spark, docs, "").collect()), key=repr)
    assert got == [(0, b), (1, a), (None, c)]


def test_units_of_a_hot_class_grow_with_its_rows(spark, monkeypatch):
    """Copies of one text with a word changed, and some that link to few or none of them: the same groups, about as many units as chunks."""
    seen, links_of = [], N._links_of

    def counted(units, sets, similarity):
        seen.append(units.select("root", "low", "high").distinct().count())
        return links_of(units, sets, similarity)

    monkeypatch.setattr(N, "_links_of", counted)
    rng, common, counts = random.Random(9), [f"c{k}" for k in range(200)], {}
    for m in (200, 400):
        texts = []
        for _ in range(m):
            words = list(common)
            words[rng.randrange(200)] = f"y{rng.randrange(10**6)}"
            texts.append(" ".join(words))
        texts += [" ".join(common[:150] + [f"e{j}{k}" for k in range(30)]) for j in range(4)]
        docs = cut(spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row long, doc_id long, text string"), "rows")
        seen.clear()
        assert {r["row"]: r["component_id"] for r in N.near_copies(docs, chunk=10).collect()} == slow_groups(enumerate(texts))
        counts[m] = sum(seen)
    assert counts[200] < 80 and counts[400] < 160  # all pairs of chunks would be 200 and 800
