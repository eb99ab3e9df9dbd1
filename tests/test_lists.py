import random

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheetwright.operators import edits, pages, photos
from sheetwright.operators.layouts import GRIDS
from sheetwright.schemas import EDITS, MANIFEST


def manifest(spark, n, layout="3x3", album=1):
    data = [(album, f"p{k}", f"P{k}", k, 0, layout) for k in range(n)]
    return spark.createDataFrame(data, MANIFEST)


@pytest.mark.parametrize("layout", [f"{r}x{c}" for r, c in GRIDS])
def test_pages_hold_no_more_than_their_capacity(spark, layout):
    r, c = map(int, layout.split("x"))
    data = [(n, f"p{k}", f"P{k}", k, 0, layout) for n in {1, r * c - 1, r * c, r * c + 1} for k in range(n)]
    cells = pages.paginate(spark.createDataFrame(data, MANIFEST))
    per_page = cells.groupBy("album_id", "page_no").agg(F.count("*").alias("n"), F.max("row").alias("r"), F.max("col").alias("c"))
    assert per_page.filter((F.col("n") > r * c) | (F.col("r") >= r) | (F.col("c") >= c)).count() == 0
    count = {x["album_id"]: x["n_pages"] for x in pages.page_count(cells.select(*MANIFEST.fieldNames())).collect()}
    assert all(v == -(-k // (r * c)) for k, v in count.items())


def test_empty_manifest(spark):
    empty = manifest(spark, 0)
    assert pages.page_count(empty).count() == 0
    assert photos.number_photos(empty.withColumn("src_seq", F.lit(1))).count() == 0


def test_adding_a_batch_twice_changes_nothing(spark):
    batch = spark.createDataFrame([(1, "x", "X", 1), (1, "y", "Y", 2), (1, "x", "X2", 3)], "album_id long, norm_path string, path string, src_seq long")
    once = photos.add_photos(manifest(spark, 2), batch)
    assert rows(once, "norm_path", "pos") == [("p0", 0), ("p1", 1), ("x", 2), ("y", 3)]
    assert rows(photos.add_photos(once, batch)) == rows(once)


@settings(max_examples=6, deadline=None)
@given(st.integers(1, 12), st.lists(st.tuples(st.integers(-1, 12), st.integers(-1, 12)), max_size=6))
def test_moves_fold_in_order(spark, n, moves):
    want, errors = [f"p{k}" for k in range(n)], 0
    for a, b in moves:
        if 0 <= a < n and 0 <= b < n:
            want.insert(b, want.pop(a))
        else:
            errors += 1
    log = spark.createDataFrame([(1, k, "move", None, a, b) for k, (a, b) in enumerate(moves)], EDITS)
    got = edits.apply_moves(manifest(spark, n), log).orderBy("pos").collect()
    assert [r["norm_path"] for r in got] == want and {r["move_error"] for r in got} == {errors}
    assert edits.apply_moves_long(manifest(spark, n), log).orderBy("pos").collect() == got


def test_many_moves_in_long_and_short_lists(spark, monkeypatch):
    """Several stretches, rounds and blocks; albums without moves, a hot one, repeated errors."""
    monkeypatch.setattr(edits, "STRETCH", 5)
    monkeypatch.setattr(edits, "BLOCK", 7)
    rng, sizes = random.Random(3), {1: 40, 2: 9, 3: 1, 4: 30}
    start = spark.createDataFrame([(a, f"p{k}", f"P{k}", k, 0, "3x3") for a, n in sizes.items() for k in range(n)], MANIFEST)
    log = [(rng.choice((1, 1, 1, 2, 3, 5)), k, "move", None, rng.randint(-1, 41), rng.randint(0, 40)) for k in range(-20, 180)]
    want, errors = {a: list(range(n)) for a, n in sizes.items()}, dict.fromkeys(sizes, 0)
    for a, _, _, _, x, y in log:
        if a in want and 0 <= x < sizes[a] and 0 <= y < sizes[a]:
            want[a].insert(y, want[a].pop(x))
        elif a in want:
            errors[a] += 1
    expected = sorted((a, f"p{p}", k, errors[a]) for a, order in want.items() for k, p in enumerate(order))
    log = spark.createDataFrame(log, EDITS)
    for f in (edits.apply_moves, edits.apply_moves_long):
        assert sorted(tuple(r) for r in f(start, log).select("album_id", "norm_path", "pos", "move_error").collect()) == expected
    none = log.filter("false")
    assert rows(edits.apply_moves_long(start, none), *MANIFEST.fieldNames()) == rows(edits.apply_moves(start, none), *MANIFEST.fieldNames()) == rows(start)


def test_one_move_and_back(spark):
    start = manifest(spark, 10)
    there = edits.move_photo(start, 2, 7)
    assert rows(there, "norm_path", "pos")[2:4] == [("p2", 7), ("p3", 2)]
    assert rows(edits.move_photo(there, 7, 2)) == rows(start)


def test_turns(spark):
    log = [(1, k, op, p, None, None) for k, (p, op) in enumerate([("a", "rotate_cw")] * 4 + [("b", "rotate_ccw")] + [("c", "rotate_cw")] * 1001)]
    got = edits.net_rotation(spark.createDataFrame(log, EDITS))
    assert rows(got, "norm_path", "rotation") == [("a", 0), ("b", 270), ("c", 90)]


def test_global_numbers_are_dense_over_partitions(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("src_seq"))
    got = photos.number_global(df, ["src_seq"])
    assert got.filter(F.col("pos") != F.col("src_seq")).count() == 0 and got.count() == 5000


def test_a_huge_album_is_numbered_over_partitions(spark):
    rows_ = spark.range(0, 4000).select(F.when(F.col("id") < 3500, 1).otherwise(F.col("id") % 50).cast("long").alias("album_id"), (F.col("id") * 7919 % 4000).alias("src_seq"), F.col("id").cast("string").alias("norm_path"))
    want = rows(photos.number_photos(rows_), "album_id", "norm_path", "pos")
    assert rows(photos.number_albums(rows_.repartition(7)), "album_id", "norm_path", "pos") == want
    assert photos.number_albums(rows_.filter("false")).count() == 0


def test_drawn_rectangles_lie_in_their_cells(spark):
    data = [(k, w, h, e, r) for k, (w, h, e, r) in enumerate([(1, 1, 1, 0), (9000, 3, 6, 90), (3, 9000, 5, 270), (400, 300, None, 180)])]
    cells = spark.createDataFrame(data, "pos int, width int, height int, exif_orientation int, rotation int").withColumn("layout", F.lit("3x4"))
    got = pages.place(pages.paginate(cells))
    e = 1e-9
    bad = (F.col("draw_x") < F.col("x_pt") - e) | (F.col("draw_x") + F.col("draw_w") > F.col("x_pt") + F.col("w_pt") + e)
    bad = bad | (F.col("draw_y") < F.col("y_pt") - e) | (F.col("draw_y") + F.col("draw_h") > F.col("y_pt") + F.col("h_pt") + e)
    assert got.filter(bad).count() == 0
    zero = cells.withColumn("width", F.lit(0))
    assert pages.place(pages.paginate(zero)).filter("draw_w IS NOT NULL").count() == 0


def test_stretches_of_drags_fold_at_once():
    """Groups of one drag to many, in lists of different lengths, against drag after drag."""
    import numpy as np

    rng = random.Random(8)
    sizes, counts = [2, 7, 40, 300, 2, 11], [1, 3, 8, 61, 5, 2]
    log = [(g, n, *rng.sample(range(n), 2)) for g, (n, m) in enumerate(zip(sizes, counts, strict=True)) for _ in range(m)]
    group, new, old, length = edits._folded(*(np.array(c, np.int64) for c in zip(*log, strict=True)))
    for g, n in enumerate(sizes):
        want = list(range(n))
        for _, _, a, b in (x for x in log if x[0] == g):
            want.insert(b, want.pop(a))
        pieces = [(new[k], old[k], length[k]) for k in range(len(group)) if group[k] == g]
        assert [p for _, start, size in pieces for p in range(start, start + size)] == want
        assert all(new_ == sum(s for _, _, s in pieces[:k]) for k, (new_, _, _) in enumerate(pieces))
        assert all(x[1] + x[2] != y[1] for x, y in zip(pieces, pieces[1:], strict=False))  # neighbours in both lists are one piece


def test_many_albums_with_few_drags_take_no_call_each(spark):
    """Python is called for batches of drags and not for each stretch or block; batches may end within a stretch."""
    rng, n = random.Random(9), 9
    log = [(rng.randrange(300), k, "move", None, rng.randint(0, n), rng.randrange(n)) for k in range(1500)]
    log += [(300, k, "move", None, rng.randrange(n), rng.randrange(n)) for k in range(1500)]
    want = {a: list(range(n)) for a in range(302)}
    for a, _, _, x, y in ((r[0], *r[2:]) for r in log):
        if x < n:
            want[a].insert(y, want[a].pop(x))
    start = spark.range(302).select(F.col("id").alias("album_id"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pos"))
    start = start.select("album_id", F.concat(F.lit("p"), "pos").alias("norm_path"), F.lit("x").alias("path"), "pos", F.lit(0).alias("rotation"), F.lit("3x3").alias("layout"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = edits.apply_moves_long(start, spark.createDataFrame(log, EDITS), stretch=200, block=4)
        assert rows(got, "album_id", "norm_path", "pos") == sorted(((a, f"p{p}", k) for a, order in want.items() for k, p in enumerate(order)), key=repr)
        plan = got._jdf.queryExecution().toString()
        assert "MapInPandas" in plan and "GroupsInPandas" not in plan
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_form_places_odd_positions_as_the_short_one(spark):
    """Photos behind the list's end or without a place stay as they are; drags without seq come first; errors are the album's."""
    places = [0, 1, 2, 3, 4, 9, 12, None, -1]
    data = [(a, f"p{k}", "x", p, 0, None) for a in (1, 2) for k, p in enumerate(places)] + [(None, "q", "x", 0, 0, None)]
    start = spark.createDataFrame(data, MANIFEST)
    log = [(1, 3, "move", None, 4, 0), (1, None, "move", None, 0, 3), (1, 9, "move", None, 2, 8), (1, 8, "move", None, 9, 0), (1, 7, "move", None, 1, None), (1, 10, "move", None, 5, 5), (2, 1, "move", None, -1, 2), (None, 1, "move", None, 0, 1)]
    log = spark.createDataFrame(log, EDITS)
    want = rows(edits.apply_moves(start, log), *MANIFEST.fieldNames())
    for stretch, block in ((None, None), (2, 4)):
        got = edits.apply_moves_long(start, log, stretch, block)
        assert rows(got, *MANIFEST.fieldNames()) == want
        assert {(r["album_id"], r["move_error"]) for r in got.collect()} == {(None, 0), (1, 2), (2, 1)}
