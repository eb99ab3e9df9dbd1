import random
import re

from conftest import DATA
from edge import documents, empty
from oracle import same
from pyspark.sql import functions as F

from sheetwright.llm import decontaminate as C
from sheetwright.llm.queries import ORACLES, op13_decontaminate

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORDS.findall((text or "").translate(UPPER))


def slow(docs, items, size=10):
    """(n_words, n_hit, items) of each text, by looking every window up at every place."""
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, names = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names |= windows[tuple(w[i : i + n])]
        out.append((repr(doc_id), len(w), len(hit), sorted(names)))
    return sorted(out)


def ours(df):
    return sorted((repr(r["doc_id"]), r["n_words"], r["n_hit"], r["items"] or []) for r in df.collect())


def test_query(spark):
    assert same(op13_decontaminate(spark, f"{DATA}/sf0.001"), ORACLES["op13_decontaminate"], f"{DATA}/sf0.001") == 200


def test_no_python_in_the_plan(spark):
    plan = op13_decontaminate(spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_random_texts_with_short_items_and_overlaps(spark):
    rng = random.Random(7)
    say = lambda n, k: " ".join(rng.choice("abcdefghijklmnop"[:k]) + rng.choice(["", ",", "!"]) for _ in range(n))
    items = [(k, say(rng.randint(0, 30), 16)) for k in range(40)] + [(50, "z"), (51, "y z"), (51, "Q r s"), (None, "t u v w")]
    docs = []
    for k in range(120):
        parts = [say(rng.randint(0, 40), 16)]
        for _ in range(rng.randint(0, 3)):
            w = split(rng.choice(items)[1])
            i = rng.randint(0, len(w))
            parts += [" ".join(w[i : i + rng.randint(0, 25)]).upper(), say(rng.randint(0, 5), 3)]
        docs.append((k, " ".join(parts)))
    docs += [(200, "z z Z"), (201, "x y-z q R\ns"), (202, "t u v w t u v w"), (203, "aaa éz z漢")]
    schema = "doc_id long, text string"
    got = C.decontaminate(spark.createDataFrame(docs, schema), spark.createDataFrame(items, "item_id long, text string"))
    want = slow(docs, items)
    assert ours(got) == want and sum(h > 0 for _, _, h, _ in want) > 40
    only_long = [(i, t) for i, t in items if len(split(t)) > 10]
    got = C.decontaminate(spark.createDataFrame(docs, schema), spark.createDataFrame(only_long, "item_id long, text string"))
    assert ours(got) == slow(docs, only_long)


def test_a_passage_that_many_share_shuffled_and_broadcast(spark):
    rng = random.Random(8)
    passage = " ".join(rng.choice("red green blue one two three".split()) + str(rng.randrange(9)) for _ in range(40))
    docs = [(k, passage if k % 2 else f"clean text number {k} of some words that no item has at all") for k in range(600)]
    items = [(k, passage) for k in range(30)] + [(99, passage[:100])]
    made = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = slow(docs, items)
    assert ours(C.decontaminate(*made)) == want and sum(h > 0 for _, _, h, _ in want) == 300
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert ours(C.decontaminate(*made)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_edges(spark):
    docs = documents(spark)
    items = spark.createDataFrame(
        [(1, "this very line of text is found in many of the documents here"), (1, "NO id"), (None, "x"), (2, None), (3, ""), (4, " .,! "), (5, "repeat " * 12)], "item_id int, text string"
    ).withColumns({c: F.lit("clash") for c in "row w window item j key len n at".split()})
    got = C.decontaminate(docs.withColumns({c: F.lit("clash") for c in "ws n_words n_hit items".split()}), items)
    assert ours(got) == slow([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert C.decontaminate(empty(spark), items).count() == 0
    none = C.decontaminate(docs, items.filter("false"))
    assert none.count() == docs.count() and none.filter("n_hit > 0 OR items IS NOT NULL").count() == 0
