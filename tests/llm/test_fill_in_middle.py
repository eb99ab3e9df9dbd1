import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from conftest import DATA
from edge import documents, empty
from oracle import same
from pyspark.sql import functions as F

from sheetwright.llm import fill_in_middle as M
from sheetwright.llm.queries import ORACLES, op11_fill_in_middle


def slow(doc_id, text, rate=100, spm=50):
    """n, form, prefix, middle, suffix by regular expressions over code points."""
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, None
    return n, "spm" if h4 % 100 < spm else "psm", "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])


def test_query(spark):
    assert same(op11_fill_in_middle(spark, f"{DATA}/sf0.001"), ORACLES["op11_fill_in_middle"], f"{DATA}/sf0.001") == 200


def test_marks_rank_and_select():
    rng = random.Random(3)
    for size in [*range(20), 63, 64, 65, 1000]:
        data = np.array([rng.choice([10, 10, 0, 9, 11, 0x8A, 0xFF, 97]) for _ in range(size)], np.uint8)
        ends = M.LineEnds(data)
        places = np.flatnonzero(data == 10)
        assert ends.rank(np.arange(size + 1)).tolist() == [int((places < i).sum()) for i in range(size + 1)]
        assert len(places) == 0 or ends.select(np.arange(1, len(places) + 1)).tolist() == (places + 1).tolist()


def test_cuts_of_a_sliced_batch():
    texts = ["é\nb\n", None, "", "\n", "\n\n\nx", "漢字\r\n🙂", "no end"] * 40
    rng = np.random.default_rng(4)
    h1, h2 = (rng.integers(0, 2**32, len(texts)) for _ in range(2))
    n, first, second = M.cuts(pa.array(["x\n", *texts, "y"]).slice(1, len(texts)), h1, h2)
    for k, t in enumerate(texts):
        units = re.findall(r"[^\n]*\n|[^\n]+", t or "")
        a, b = sorted((h1[k] % (len(units) + 1), h2[k] % (len(units) + 1)))
        assert (n[k], first[k], second[k]) == (len(units), len("".join(units[:a]).encode()), len("".join(units[:b]).encode()))


def test_edges_and_round_trip(spark):
    docs = documents(spark, [(20, "a <P> b\nc", "en", "a", 1), (21, "a <\nS> b\n\n", "en", "a", 1), (22, "<\nP\n>" * 9, "en", "a", 1), (23, "x\r\ny\0\n", "en", "a", 1)])
    rows = M.fill_in_middle(docs)
    got = rows.withColumn("back", M.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == docs.count() and {r["doc"]["form"] if "form" in docs.columns else None for r in got} == {None}
    for r in got:
        want = slow(r["doc"]["doc_id"], r["doc"]["text"])
        assert (r["n"], r["form"], r["prefix"], r["middle"], r["suffix"]) == want
        assert r["back"] == (r["doc"]["text"] or "")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"} and {r["doc"]["kept"] for r in got} == {"clash"}
    assert M.fill_in_middle(empty(spark)).count() == 0


def test_rate_and_order(spark):
    docs = spark.createDataFrame([(k, f"one {k}\ntwo\nthree") for k in range(400)], "doc_id long, text string")
    for rate, spm in ((0, 50), (30, 100), (100, 0)):
        got = M.fill_in_middle(docs, rate=rate, spm=spm).collect()
        assert all((r["n"], r["form"]) == slow(r["doc"]["doc_id"], r["doc"]["text"], rate, spm)[:2] for r in got)
    with_clash = docs.withColumns({c: F.lit("clash") for c in "n form prefix middle suffix output body cut h1 h2 h3 h4".split()})
    assert M.fill_in_middle(with_clash).filter("doc.cut = 'clash' AND n = 3").count() == 400
