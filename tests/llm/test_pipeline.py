from collections import Counter

import pytest
import sentencepiece
from conftest import DATA
from edge import LABELS, documents, empty
from pyspark.sql import functions as F
from test_lines_and_licenses import slow_dedup
from test_near_copies import slow_groups
from test_quality import slow_counts

import corpus_pipeline as C
from sheetwright.llm import mixing
from sheetwright.llm.common import cut, table
from sheetwright.llm.queries import PIECE_MODEL


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def check_lines(before, after):
    want = slow_dedup([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted((repr(r["doc_id"]), r["text"] or "") for r in after.collect()) == sorted((i, kept) for i, _, _, kept in want)


def check_near_copies(before, after):
    """The rows that stay: of each group by brute force, a row with the least id."""
    rows = before.collect()
    groups = slow_groups([(k, r["text"]) for k, r in enumerate(rows)])
    held = {}
    for k, r in enumerate(rows):
        held.setdefault(groups[k], []).append(r)
    key = lambda i: (i is None, i)
    want = sorted((repr(min((r["doc_id"] for r in g), key=key)) for g in held.values()))
    got = after.collect()
    assert sorted(repr(r["doc_id"]) for r in got) == want
    assert not Counter(map(repr, got)) - Counter(map(repr, rows))


def slow_mix(rows, weights=(3, 1, 2), share=1.5):
    """Target of each source, by filling up one source after another."""
    size = {}
    for source, n in rows:
        size[source] = size.get(source, 0) + n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    full, left = set(), share * sum(size.values())
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left / total * w[s] > 2 * size[s]]
        if not over:
            return {s: 2.0 * size[s] if s in full else left / total * w[s] for s in names}, size
        full.update(over)
        left -= sum(2 * size[s] for s in over)


def check_mixture(before, after):
    n = lambda t: len((t or "").encode().split())
    rows = [(r["source"], n(r["text"]), repr(r)) for r in before.collect()]
    target, _ = slow_mix([(s, k) for s, k, _ in rows])
    taken, times = Counter(), Counter(repr(r) for r in after.collect())
    longest = Counter()
    for s, k, _ in rows:
        longest[s] = max(longest[s], k)
    for r in after.collect():
        taken[r["source"]] += n(r["text"])
    assert all(abs(taken[s] - t) <= longest[s] / 2 + 1 for s, t in target.items())
    stock = Counter(x for _, _, x in rows)
    assert all(times[x] <= 2 * stock[x] for x in times)


def check_pieces(before, after):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    want = sorted((repr(r["doc_id"]), lib.encode(r["text"] or "")) for r in before.collect())
    got = after.collect()
    assert sorted((repr(r["doc_id"]), list(r["ids"])) for r in got) == want
    assert all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in got)


CHECKS = {"lines": check_lines, "near_copies": check_near_copies, "mixture": check_mixture, "pieces": check_pieces}


def test_stages(spark):
    """Each stage on what the one before kept, against brute force."""
    sf = f"{DATA}/sf0.001"
    docs = start = table(spark, sf, "documents")
    for name, stage in C.STAGES:
        before, docs = docs, cut(stage(spark, docs, sf), name)
        if name != "pieces":
            assert docs.dtypes == start.dtypes
        if name == "quality":
            kept = {r["doc_id"]: r["text"] for r in docs.collect()}
            good = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            failed = {i for i, t in texts.items() for n in [slow_counts(t or "")] if n[0] < 50 or 100 * n[4] > 50 * n[0]}
            assert 0 < len(kept) < len(texts) and not failed & set(kept) and all(kept[i] == texts[i] for i in kept)
            right = [(i in kept) == bool(y) for i, y in good.items() if i in texts and i not in failed]
            assert sum(right) >= 0.95 * len(right)
        else:
            CHECKS[name](before, docs)
    assert C.run(spark, sf).count() == docs.count()


def test_lines_follow_their_length(spark):
    line = "a line that repeats in all of the documents of this small table"
    docs = spark.createDataFrame([(k, f"{line}\nown {k}", 99) for k in range(6)], "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, C.lines(spark, docs, "").collect())) == [(k, f"own {k}", 5) for k in range(5)] + [(5, f"{line}\nown 5", 99)]


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_edges_of_each_stage(spark, name, tmp_path):
    """Nulls in all columns, empty and long texts, ties, repeated rows, clashing columns; no n_chars; an empty table."""
    stage = dict(C.STAGES)[name]
    (tmp_path / "sf").mkdir()
    sf = f"file://{tmp_path}/sf"
    spark.createDataFrame([(3, 1, 0), (4, 1, 0), (None, 0, 0), (12, 0, None), (7, None, 1)], LABELS).write.parquet(f"{sf}/labels.parquet")
    docs = cut(documents(spark), "edge")
    for some in (docs, docs.drop("n_chars", "lang")):
        out = cut(stage(spark, some, sf), "edge-out")
        if name == "quality":
            for r in out.collect():
                n = slow_counts(r["text"] or "")
                assert n[0] >= 50 and 100 * n[4] <= 50 * n[0]
            assert not Counter(map(repr, out.collect())) - Counter(map(repr, some.collect()))
        else:
            CHECKS[name](some, out)
        if name != "pieces":
            assert out.dtypes == some.dtypes
    assert stage(spark, cut(empty(spark), "edge"), sf).count() == 0


def test_mix_is_the_same_in_reruns(spark):
    docs = documents(spark).withColumn("source", F.col("source"))
    once = plain(mixing.mix_sources(docs).select("doc.doc_id", "size", "source_size", "target", "taken"))
    assert once == plain(mixing.mix_sources(docs.repartition(5)).select("doc.doc_id", "size", "source_size", "target", "taken"))
