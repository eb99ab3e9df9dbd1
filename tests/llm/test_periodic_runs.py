import hashlib
import random
import re
import zlib

import numpy as np
from conftest import DATA
from edge import documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import same
from pyspark.sql import functions as F

from sheetwright.llm import periodic_runs as P
from sheetwright.llm.queries import ORACLES, op12_periodic_runs, planted

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(w):
    """All runs (start, length, period): for each period all stretches, of one stretch the smallest period."""
    out, seen = [], set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and j > i and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_collapse(w, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def slow_planted(doc_id, text):
    w = WORDS.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def check(texts):
    for t, (runs, rest) in zip(texts, P.find_in_texts([None if t is None else t.encode() for t in texts])):
        w = WORDS.findall(t or "")
        assert runs == slow_runs(w) and rest.decode() == slow_collapse(w, runs)


def test_query_is_the_brute_force_on_whole_tables(spark):
    sf_dir = f"{DATA}/sf0.001"
    got = {r["doc_id"]: r for r in op12_periodic_runs(spark, sf_dir).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    n_with = 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        w = slow_planted(r["doc_id"], r["text"])
        runs = slow_runs(w)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want = (len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], digest("".join("%d,%d,%d\n" % x for x in runs)), digest(slow_collapse(w, runs)))
        g = got[r["doc_id"]]
        assert tuple(g[c] for c in "n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()) == want
        n_with += bool(runs)
    assert n_with > 5 and len(got) == 200


def test_query_equals_sql(spark):
    assert same(op12_periodic_runs(spark, f"{DATA}/sf0.001"), ORACLES["op12_periodic_runs"], f"{DATA}/sf0.001") == 200


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("ab", min_size=1, max_size=5), st.integers(1, 6)), max_size=12), min_size=1, max_size=4))
def test_any_texts(parts):
    check([" ".join(" ".join(unit) for unit, times in text for _ in range(times)) for text in parts])


def test_periods_long_nested_and_side_by_side():
    rng = random.Random(5)
    unit = [f"w{rng.randrange(500)}" for _ in range(700)]
    texts = [
        " ".join(unit * 4 + unit[:300]),
        " ".join(unit * 3),
        " ".join((["x"] * 9 + unit[:20]) * 5),
        " ".join("ab" * 30 + "b" * 7 + "ba" * 30),
        " ".join(c for k in range(200) for c in [f"v{k}"] * 6),
        "a b c " * 3 + "a b", "a b c " * 4, "a " * 5, "a " * 6, "", None, " \n\t",
    ]
    check(texts)
    check(texts[2:] * 3)
    assert P.find_in_texts([b"same " * 50_000]) == [([(0, 50_000, 1)], b"same")]


def test_grammar_spells_each_document_and_repeats_no_pair():
    rng = random.Random(6)
    docs = [[rng.randrange(4) for _ in range(rng.randint(1, 200))] for _ in range(30)]
    ids, sizes = np.array([x for d in docs for x in d]), [len(d) for d in docs]
    starts = np.cumsum(sizes) - sizes
    g = P.Grammar(ids, starts)
    assert g.pos.tolist() == starts.tolist() and g.words.tolist() == sizes
    spell = lambda k: tuple(ids[g.first[k] : g.first[k] + g.size[k]])
    for k, at in zip(g.symbols, g.places):  # each place of a nonterminal spells what its first one does
        assert tuple(ids[at : at + g.size[k]]) == spell(k)
    assert len(g.first) < sum(sizes) / 2  # nonterminals that repeat are computed once
    assert sorted(np.unique(g.symbols)) == list(range(len(g.first)))


def test_edges(spark):
    docs = documents(spark)
    got = P.periodic_runs(docs).collect()
    assert len(got) == docs.count() and {r["doc"]["fp"] for r in got} == {"clash"}
    for r in got:
        w = WORDS.findall(r["doc"]["text"] or "")
        if len(w) < 5000:
            assert [tuple(x) for x in r["runs"]] == slow_runs(w) and r["collapsed"] == slow_collapse(w, [tuple(x) for x in r["runs"]])
    assert P.periodic_runs(empty(spark)).count() == 0
    want = {repr((r["doc_id"], " ".join(slow_planted(r["doc_id"], r["text"])))) for r in docs.collect()}
    assert {repr((r["doc_id"], " ".join(WORDS.findall(r["text"] or "")))) for r in planted(docs.select("doc_id", "text")).collect()} == want
    clash = docs.withColumns({c: F.lit("clash") for c in ("runs", "found", "collapsed")})
    assert P.periodic_runs(clash).filter("doc.runs = 'clash'").count() == docs.count()
