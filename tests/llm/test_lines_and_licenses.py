import hashlib
import os
import random

import pytest
from conftest import DATA
from edge import documents, empty
from oracle import same
from pyspark.sql import functions as F

from sheetwright.llm import license_scan as L
from sheetwright.llm import line_dedup as D
from sheetwright.llm.queries import ORACLES, op8_license_digest, op9_line_dedup

SPACE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_dedup(docs, min_chars=40, min_docs=5):
    """(id, n_lines, n_dropped, kept) of (id, text), ids null as the least."""
    key = lambda x: x.strip(SPACE).translate(UPPER)
    held = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held.setdefault(key(x), set()).add(D.NO_ID if i is None else i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(held.get(key(x), ())) < min_docs or max(held[key(x)]) == (D.NO_ID if i is None else i)]
        out.append((repr(i), len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


def ours(df):
    return sorted((repr(r["doc"]["doc_id"]), r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect())


def test_line_query(spark):
    assert same(op9_line_dedup(spark, f"{DATA}/sf0.001"), ORACLES["op9_line_dedup"], f"{DATA}/sf0.001") == 200


def test_line_edges(spark):
    docs = documents(spark)
    want = slow_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = D.dedup_lines(docs)
    assert ours(got) == want and any(d for _, _, d, _ in want)
    assert {r["doc"]["drops"] for r in got.collect()} == {"clash"}
    assert D.dedup_lines(empty(spark)).count() == 0


def test_many_batches_and_merges(spark):
    rng = random.Random(6)
    pool = [f"line number {k} with words enough to be of some length" + "é" * (k % 3) for k in range(60)]
    data = [(k, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(0, 9)))) for k in rng.sample(range(1000), 150)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = slow_dedup(data)
    for batches, fanout in ((1, 2), (4, 2), (7, 3)):
        assert ours(D.dedup_lines(df, batches=batches, fanout=fanout)) == want


def test_runs_hold_each_line_once_and_levels_compact(spark):
    runs = D.LineRuns(spark, fanout=2)
    batch = lambda ids, doc: spark.createDataFrame([(i, i, doc) for i in ids], "h1 long, h2 long, doc_id long")
    runs.add(batch(range(10), 30))
    assert runs.unseen(batch(range(5, 15), 20)).count() == 5
    runs.add(batch(range(5, 15), 20))
    assert [len(x) for x in runs.levels] == [0, 1]
    runs.add(batch(range(3), 10))
    assert [len(x) for x in runs.levels] == [1, 1]
    got = {r["h1"]: (r["n_docs"], r["keeper"]) for r in runs.totals().collect()}
    assert got == {i: (1 + (5 <= i < 10) + (i < 3), 30 if i < 10 else 20) for i in range(15)}
    held = [r["h1"] for run in runs.runs() for r in spark.table(run).collect()]
    assert sorted(held) == list(range(15))
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_a_batch_is_written_once_and_in_few_files(spark):
    """Fresh lines go straight into their run, and counts of seen ones aren't a file a bucket."""
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/sheetwright"
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        runs = D.LineRuns(spark)
        batch = lambda first, last, doc: spark.range(first, last).selectExpr("id AS h1", "id AS h2", f"{doc}L AS doc_id")
        runs.add(batch(0, 2000, 30))
        before = set(os.listdir(shared))
        runs.add(batch(1000, 3000, 20))
        assert sorted(name.rsplit("-", 1)[0] for name in set(os.listdir(shared)) - before if not name.startswith("line_run_")) == ["line-batch", "line-later"]
        later = runs.later[0].removeprefix("file://")
        assert 0 < len([f for f in os.listdir(later) if f.endswith(".parquet")]) <= 8
        assert sorted(tuple(r) for r in spark.read.parquet(runs.later[0]).collect()) == [(i, i, 1) for i in range(1000, 2000)]
        got = {r["h1"]: (r["n_docs"], r["keeper"]) for r in runs.totals().collect()}
        assert got == {i: (1 + (1000 <= i < 2000), 30 if i < 2000 else 20) for i in range(3000)}
        runs.close()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_many_lines_and_ids_that_repeat_with_other_texts(spark):
    line = lambda k: f"line {k} that is long enough to count as one of those that repeat"
    data = [(k % 7, "\n".join(line(j) for j in range(k, 3000, 1 + k % 3)) + f"\nend {k}") for k in range(15)]
    data += [(None, f"{line(1)}\n{line(1)}\nno id {k}") for k in range(4)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert ours(D.dedup_lines(df)) == slow_dedup(data)


def test_license_query(spark):
    assert same(op8_license_digest(spark, f"{DATA}/sf0.001"), ORACLES["op8_license_digest"], f"{DATA}/sf0.001") == 200


def test_license_variants(spark):
    mit = dict(L.LICENSES)["MIT"]
    texts = [
        mit,
        mit.upper(),
        "Copyright (c) 2020 Some Body\n\n" + mit.replace(",", " ,").replace('"', "'") + "\n\n(c) others",
        mit.replace("sublicense", "sub-licence").replace("and/or", "and / or"),
        mit + " and one more clause",
        "MIT",
        "Some words.\nReleased under the MIT licence\nLicensed under the APACHE License; version 2.0!\nnot a license",
    ]
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in L.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {**{k: ("MIT", []) for k in range(4)}, 4: (None, []), 5: (None, []), 6: (None, ["MIT", "Apache-2.0"])}


def test_license_edges(spark):
    docs = documents(spark)
    got = L.scan_licenses(docs).collect()
    assert len(got) == docs.count() and {r["license_id"] for r in got} == {None}
    assert {r["digest"] for r in got if r["doc_id"] in (0, 1, 2)} == {hashlib.sha256(b"").hexdigest()}
    assert L.scan_licenses(empty(spark)).count() == 0
    same_text = spark.createDataFrame([("b", "X y"), ("a", "x Y!")], "license_id string, text string")
    assert L.scan_licenses(spark.createDataFrame([(1, "x, y")], "doc_id long, text string"), licenses=same_text).first()["license_id"] == "a"
    assert spark.range(1).select(L.canonical(F.lit("  A—b\tC_d é ")).alias("x")).first()["x"] == "a b c d é"


def test_license_files_as_they_are_shipped(spark):
    """Titles, copyright statements, any wrapping and typographic quotes leave the license known."""
    import textwrap

    known = dict(L.LICENSES)
    wrap = lambda t, n: "\n\n".join(textwrap.fill(x, n) for x in t.split("\n"))
    texts = [(i, wrap(t, n)) for i, t in known.items() for n in (40, 72, 76, 80)]
    texts += [(i, f"{title}\n\nCopyright (c) 2020 A\n\n{wrap(known[i], 78)}\n") for i, title in (("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("ISC", "ISC License"), ("BSD-3-Clause", "BSD 3-Clause License"))]
    texts += [("MIT", known["MIT"].replace('"Software"', "“Software”").replace('"AS IS"', "“AS IS”")), ("Zlib", known["Zlib"].replace("'as-is'", "‘as‑is’"))]
    texts += [(None, "MIT License\n\nCopyright (c) 2020 A"), (None, "")]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in L.scan_licenses(docs).collect()}
    assert got == {k: i for k, (i, _) in enumerate(texts)}


SHIPPED = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(SHIPPED), reason="no folder of license texts")
@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0"])
def test_long_license_texts_from_a_folder(spark, name):
    """Whole texts in other case, wrapping, punctuation and spelling, under another copyright statement."""
    if not os.path.isfile(f"{SHIPPED}/{name}"):
        pytest.skip("no such text")
    known = L.license_files(spark, [f"{SHIPPED}/{name}"])
    text = known.first()["text"]
    assert known.first()["license_id"] == name
    variants = [text, text.upper(), text.replace("license", "licence"), text.replace(", ", " , ").replace('"', "\u201c"), "Copyright (c) 2021 Some Body\n\n" + text + "\n"]
    others = [text + " one clause more", text[: len(text) // 2], ""]
    docs = spark.createDataFrame(list(enumerate(variants + others)), "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in L.scan_licenses(docs, licenses=known).collect()}
    assert got == {k: name if k < len(variants) else None for k in range(len(variants) + len(others))}


@pytest.mark.skipif(not os.path.isfile(f"{SHIPPED}/MPL-2.0"), reason="no folder of license texts")
def test_query_with_a_folder_equals_its_sql(spark, tmp_path):
    """Whole long texts, as they are shipped and changed, beside short ones and notices; some lines end in other ways."""
    import shutil

    folder = tmp_path / "licenses"
    folder.mkdir()
    names = ["Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0"]
    for n in names:
        shutil.copyfile(f"{SHIPPED}/{n}", folder / f"{n}.txt")
    texts = [(folder / f"{n}.txt").read_text() for n in names]
    texts += [t.upper() for t in texts] + [t.replace("\n", "\r\n") for t in texts] + ["(c) 2020 A\u2028MIT License\n" + dict(L.LICENSES)["MIT"], "x\rcopyright 2020 y", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/sf/documents.parquet")
    from sheetwright.llm.queries import op8_sql

    got = op8_license_digest(spark, f"{tmp_path}/sf", folder=str(folder))
    assert [r["license_id"] for r in got.orderBy("doc_id").collect()[:15]] == names * 3
    assert same(got, op8_sql(str(folder)).replace("FROM documents", f"FROM '{tmp_path}/sf/documents.parquet/*.parquet'"), f"{DATA}/sf0.001") == len(texts)
