"""Manifest tables, listings, probing by ranges, watched folders."""

import os
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_files import bmp, jpeg

from sheetwright.operators import photos
from sheetwright.schemas import MANIFEST
from sheetwright.sources import ranges, raster, scan
from sheetwright.sources.snapshots import CommitConflict, ManifestTable
from sheetwright.streaming.watch import watch_into

BATCH = "album_id long, norm_path string, path string, src_seq long"


def manifest(spark, n, album=1):
    return spark.createDataFrame([(album, f"p{k}", f"P{k}", k, 0, "3x3") for k in range(n)], MANIFEST)


def listed(table, version=None):
    return rows(table.read(version), "norm_path", "pos", "rotation")


def test_versions_edits_in_place_and_time_travel(spark, tmp_path):
    table = ManifestTable(spark, f"file:{tmp_path}/album")
    assert table.version() == 0 and table.read().count() == 0 and table.read().schema == MANIFEST
    assert table.replace(manifest(spark, 4)) == 1
    assert table.replace(table.read().withColumn("rotation", (F.col("pos") * 90 % 360).cast("int"))) == 2  # read and saved where it lies
    edited = table.read().filter("pos <> 2").withColumn("rotation", F.when(F.col("pos") == 1, 0).otherwise(F.col("rotation")).cast("int"))
    assert table.save(edited) == 3
    part = table.state()["parts"][-1]
    assert spark.read.parquet(f"{table.path}/{part['name']}").count() == 2  # one photo turned, one gone; the others aren't written
    assert listed(table) == [("p0", 0, 0), ("p1", 1, 0), ("p3", 3, 270)]
    assert listed(table, 1) == [(f"p{k}", k, 0) for k in range(4)]
    batch = spark.createDataFrame([(1, "p2", "again", 1), (1, "p0", "P0", 2), (1, "new", "N", 3)], BATCH)
    table.add(batch)  # a photo that was taken out can come again, behind the change that took it out
    assert listed(table) == [("new", 5, 0), ("p0", 0, 0), ("p1", 1, 0), ("p2", 4, 0), ("p3", 3, 270)]
    assert spark.read.parquet(f"{table.path}/{table.state()['parts'][-1]['name']}").count() == 2  # only the batch's fresh photos
    table.change(table.read().filter("norm_path = 'p2'"), F.lit(True))
    before = listed(table)
    assert ("p2", 4, 0) not in before
    table.compact()
    assert listed(table) == before and len(table.state()["parts"]) == 1
    assert len(table.vacuum()) == 5 and table.versions() == [6] and listed(table) == before and table.vacuum() == []


def test_a_job_that_dies_leaves_the_old_state(spark, tmp_path):
    table = ManifestTable(spark, f"{tmp_path}/album")
    table.replace(manifest(spark, 6))
    broken = table.read().withColumn("pos", F.when(F.col("pos") < 3, F.col("pos")).otherwise(F.raise_error(F.lit("killed")).cast("int")))
    for job in (lambda: table.replace(broken), lambda: table.save(broken), lambda: table.change(broken)):
        with pytest.raises(Exception, match="killed"):
            job()
        assert table.version() == 1 and listed(table) == [(f"p{k}", k, 0) for k in range(6)]
    # a writer that died between its part and its commit: the part is there, and nobody sees it
    table._part(manifest(spark, 9), "rows")
    assert table.read().count() == 6 and len(table.vacuum()) >= 1 and table.read().count() == 6


def test_the_second_of_two_writers_is_told(spark, tmp_path):
    table, other = (ManifestTable(spark, f"{tmp_path}/album") for _ in range(2))
    table.replace(manifest(spark, 2))
    base = other.state()
    table.replace(manifest(spark, 3))
    with pytest.raises(CommitConflict):
        other._commit(base, [])
    assert table.version() == 2 and other.read().count() == 3
    assert [n for n in os.listdir(tmp_path / "album" / "log") if n.endswith(".tmp")] == []


def test_random_histories(spark, tmp_path):
    rng, table, want, end = random.Random(9), ManifestTable(spark, f"{tmp_path}/album"), {}, -1
    for step in range(6):
        names = rng.sample("abcdefghij", 4)
        if step % 2 == 0:
            fresh = sorted(n for n in names if n not in want)
            end = max((p for p, _ in want.values()), default=-1)
            want.update({n: (end + 1 + k, 0) for k, n in enumerate(fresh)})
            table.add(spark.createDataFrame([(1, n, n, 0) for n in names], BATCH))
        else:
            some = [n for n in names if n in want]
            gone = set(some[:1])
            data = [(1, n, n, want[n][0], 90 * step % 360, None) for n in some]
            table.change(spark.createDataFrame(data, MANIFEST), F.col("norm_path").isin(*gone) if gone else None)
            want = {n: (p, 90 * step % 360 if n in some else r) for n, (p, r) in want.items() if n not in gone}
        assert listed(table) == sorted((n, p, r) for n, (p, r) in want.items())
    assert listed(table) == listed(table, table.compact())


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    table = ManifestTable(spark, f"{tmp_path}/album")
    batch = spark.createDataFrame([(1, "x", "X", 0)], BATCH)
    assert table.add(batch, ("camera", 0)) == 1 and table.add(batch, ("camera", 0)) == 1
    assert table.add(batch, ("camera", 1)) == 2 and table.add(batch, ("phone", 0)) == 3 and table.add(batch, ("camera", 0)) == 3
    assert table.compact() == 4 and table.state()["batches"] == {"camera": 1, "phone": 0} and listed(table) == [("x", 0, 0)]


def test_watched_folder_exactly_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    table = ManifestTable(spark, f"{tmp_path}/album")
    run = lambda cp="cp": watch_into(table, str(folder), str(tmp_path / cp), 5, source="in").awaitTermination()
    (folder / "b.jpg").write_bytes(b"x")
    (folder / "c.txt").write_bytes(b"x")
    run()
    (folder / "a.jpg").write_bytes(b"y")
    run()
    names = lambda: [r["path"][-5:] for r in table.read().orderBy("pos").collect()]
    assert names() == ["b.jpg", "a.jpg"] and table.version() == 2
    # the job died after the commit and before the checkpoint's note of it: the batch is delivered again
    os.remove(tmp_path / "cp" / "commits" / "1")
    (tmp_path / "cp" / "commits" / ".1.crc").unlink(missing_ok=True)
    run()
    assert names() == ["b.jpg", "a.jpg"] and table.version() == 2
    (folder / "d.jpg").write_bytes(b"z")
    run()
    assert names() == ["b.jpg", "a.jpg", "d.jpg"] and table.version() == 3 and table.state()["batches"] == {"in": 2}


def test_walks_of_deep_and_wide_trees(spark, tmp_path):
    deep = tmp_path / "deep" / "/".join(f"d{k}" for k in range(150))
    deep.mkdir(parents=True)
    want = {f"{deep}/_end.jpg", f"{tmp_path}/deep/.top.jpg"}
    for k in range(60):
        (tmp_path / "wide" / f".w{k}").mkdir(parents=True)
        want.add(f"{tmp_path}/wide/.w{k}/x {k}.png")
    for p in want:
        with open(p, "wb") as f:
            f.write(b"abc")
    os.symlink(tmp_path, tmp_path / "wide" / "loop")
    roots = [f"file:{tmp_path}/deep", f"{tmp_path}/wide", f"{tmp_path}/wide", f"{tmp_path}/nowhere"]
    for entries in (7, 20_000):  # a task hands folders back after some entries
        got = scan.walk(spark, roots, entries=entries).collect()
        assert sorted(r["path"][5:] for r in got if r["kind"] == "file") == sorted(want)
        assert {(r["path"][5:], r["error"]) for r in got if r["kind"] == "error"} == {(f"{tmp_path}/nowhere", "No such file or directory")}
        assert {r["length"] for r in got if r["kind"] == "file"} == {3}
    assert scan.walk(spark, []).count() == 0


def test_chosen_files_by_one_rule(spark, tmp_path):
    for n in ("_a.jpg", "b [1].jpg"):
        (tmp_path / n).write_bytes(b"xy")
    some = [f"{tmp_path}/_a.jpg", f"file:{tmp_path}/b [1].jpg"]
    assert rows(scan.load_paths(spark, some), "length") == [(2,), (2,)]
    for gone in ("_c.jpg", "c.jpg"):
        paths = spark.createDataFrame([(p,) for p in [*some, f"{tmp_path}/{gone}"]], "path string")
        with pytest.raises(Exception, match="FileNotFoundError"):
            scan.load_paths(spark, paths).collect()
        assert scan.load_paths(spark, paths, "skip").count() == 2
        kept = scan.load_paths(spark, paths, "keep").filter("length IS NULL").first()
        assert kept["path"] == f"file:{tmp_path}/{gone}" and kept["modificationTime"] is None


def test_content_that_cannot_be_read_says_why(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"xy")
    files = spark.createDataFrame([(f"file:{tmp_path}/a.jpg",), (f"{tmp_path}/gone.jpg",), ("nosuch://host/a.jpg",), (None,)], "path string")
    got = {r["path"]: (r["content"] and bytes(r["content"]), r["content_error"]) for r in scan.with_content(files, errors=True).collect()}
    assert got[f"file:{tmp_path}/a.jpg"] == (b"xy", None) and [c for c, e in got.values() if e] == [None] * 3
    assert scan.with_content(files).columns == ["path", "content"]


def test_listing_changes_feed_the_list(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 2, None), ("c", 3, None)], "path string, length long, modificationTime timestamp")
    new = spark.createDataFrame([("b", 2, None), ("c", 4, None), ("d", 5, None)], "path string, length long, modificationTime timestamp")
    assert rows(scan.listing_changes(old, new), "path", "change", "length") == [("a", "gone", 1), ("c", "changed", 4), ("d", "added", 5)]
    assert scan.listing_changes(new, new).count() == 0
    added = photos.with_paths(scan.listing_changes(old, new).filter("change = 'added'"), windows=False)
    assert rows(photos.incoming(added, 3), "path") == [("d",)]


def test_probing_reads_little_and_finds_headers_far_behind(spark, tmp_path):
    far = jpeg(40, 30, 6)
    segment = b"\xff\xe2" + (60_000).to_bytes(2, "big") + b"\0" * 59_998
    at = far.index(b"\xff\xc0")
    files = {
        "far.jpg": far[:at] + segment * 20 + far[at:] + b"\0" * 500_000,
        "fill.jpg": far[:2] + b"\xff\xff\xff" + far[2:],
        "a.png": raster.to_png(raster.pixels_of(bmp(__import__("numpy").zeros((3, 5, 3), "uint8")))) + b"\0" * 500_000,
        "no.jpg": b"\xff\xd8" + segment, "empty.jpg": b"", "text.jpg": b"text",
    }
    for n, data in files.items():
        (tmp_path / n).write_bytes(data)
    listing = scan.scan_files(spark, str(tmp_path), hidden=True).unionByName(spark.createDataFrame([("gone.jpg", None, 0), (None, None, 0)], "path string, modificationTime timestamp, length long"))
    found = ranges.probe_paths(listing)
    assert "content" not in found._jdf.queryExecution().toString()
    got = {(r["path"] or "").rpartition("/")[2]: r for r in found.collect()}
    assert [got["far.jpg"][c] for c in ("format", "width", "height", "exif_orientation")] == ["jpeg", 40, 30, 6]
    assert (got["fill.jpg"]["width"], got["a.png"]["width"], got["a.png"]["format"]) == (40, 5, "png")
    assert all(got[n]["probe_error"] for n in ("no.jpg", "empty.jpg", "text.jpg", "gone.jpg", ""))
    assert got["a.png"]["probe_bytes"] <= ranges.FIRST and got["far.jpg"]["probe_bytes"] < len(files["far.jpg"])
    digests = ranges.file_digests(listing.filter("path LIKE '%.jpg'"), "full").collect()
    import hashlib

    want = {n: hashlib.sha256(d).hexdigest() for n, d in files.items()} | {"gone.jpg": None}
    assert {r["path"].rpartition("/")[2]: r["digest"] for r in digests} == {n: want[n] for n in want if n.endswith(".jpg")}


def test_moved_originals(spark, tmp_path):
    for n, data in {"here.jpg": b"1" * 9000, "new.jpg": b"2" * 9000, "copy.jpg": b"2" * 9000, "near.jpg": b"2" * 8999 + b"3"}.items():
        (tmp_path / n).write_bytes(data)
    files = photos.with_paths(scan.scan_files(spark, str(tmp_path), hidden=True), windows=False).select("path", "norm_path", "length")
    known = ranges.file_digests(ranges.file_digests(files, "head").withColumnRenamed("digest", "head"), "full").withColumnRenamed("digest", "full")
    kept = lambda n, name: known.filter(F.col("path").endswith(n)).select(F.lit(name).alias("norm_path"), "length", "head", "full")
    listed_ = kept("/here.jpg", f"{tmp_path}/here.jpg").unionByName(kept("/new.jpg", "/old/2.jpg")).unionByName(kept("/near.jpg", "/old/4.jpg").withColumn("full", F.lit("other")))
    got = {r["norm_path"].rpartition("/")[2]: (r["state"], (r["new_path"] or "").rpartition("/")[2], r["n_copies"]) for r in photos.moved_originals(listed_, files, ranges.file_digests).collect()}
    assert got == {"here.jpg": ("found", "", None), "2.jpg": ("moved", "copy.jpg", 2), "4.jpg": ("missing", "", None)}


def scanned_rows(df):
    """Rows that the scan gave on, after row groups were passed over."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    while plan.getClass().getSimpleName() != "FileSourceScanExec":
        plan = plan.children().apply(0) if plan.children().size() else plan.plan()
    return plan.metrics().apply("numOutputRows").value()


def test_lookups_pass_over_row_groups(spark, tmp_path):
    from sheetwright.operators.pages import paginate
    from sheetwright.sources import lookup

    names = F.sha2(F.col("id").cast("string"), 256)
    listed_ = spark.range(40_000).select((F.col("id") % 8).alias("album_id"), names.alias("norm_path"), names.alias("path"), F.floor(F.col("id") / 8).cast("int").alias("pos"), F.lit(0).alias("rotation"), F.lit("4x4").alias("layout"))
    path = f"{tmp_path}/cells"
    lookup.write_cells(paginate(listed_), path, group_bytes=1 << 17, names=2_000)
    total = spark.read.parquet(path).count()
    page = lookup.page_photos(spark, path, [(3, 17), (3, 18)])
    assert total == 40_000 and rows(page, "pos") == [(k,) for k in range(17 * 16, 19 * 16)] and scanned_rows(page) < total / 8
    some = [r["norm_path"] for r in spark.read.parquet(path).filter("pos = 77 AND album_id IN (1, 6)").collect()]
    places = lookup.photo_places(spark, path, some)
    assert rows(places, "album_id", "page_no", "slot") == [(1, 4, 13), (6, 4, 13)] and scanned_rows(places) < total / 4
    assert lookup.photo_places(spark, path, ["no such photo"]).count() == 0 and lookup.photo_places(spark, path, []).count() == 0
    many = [r["norm_path"] for r in spark.read.parquet(path).filter("pos < 100").collect()]
    assert lookup.photo_places(spark, path, many).count() == lookup.photo_places(spark, path, spark.createDataFrame([(n,) for n in many], "norm_path string")).count() == 800


def test_states_are_written_once_or_not_at_all(spark, tmp_path):
    from sheetwright.operators.manifests import pack_manifest, unpack_manifest
    from sheetwright.sources.states import read_states, vacuum_states, write_states

    path = f"file:{tmp_path}/states"
    states = pack_manifest(manifest(spark, 50), F.floor(F.col("pos") / 7))
    write_states(states, path)
    back = read_states(spark, path)
    assert back.count() == back.count() == 8 and rows(unpack_manifest(back), "path", "pos") == rows(manifest(spark, 50), "path", "pos")
    files = sorted(os.listdir(tmp_path / "states"))
    broken = states.withColumn("state", F.when(F.col("block") < 5, F.col("state")).otherwise(F.raise_error(F.lit("killed"))))
    with pytest.raises(Exception, match="killed"):
        write_states(broken, path)
    assert read_states(spark, path).count() == 8
    vacuum_states(path)  # of tasks that were still running at the abort
    assert sorted(os.listdir(tmp_path / "states")) == files and read_states(spark, path).count() == 8
    write_states(states.filter("block = 1"), path)
    assert read_states(spark, path).count() == 9
    write_states(states.filter("block < 2"), path, "overwrite")
    assert read_states(spark, path).count() == 2
    assert read_states(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError, match="mounted"):
        read_states(spark, "hdfs://host/states")


def test_tiles_of_any_size(spark):
    import numpy as np

    from sheetwright.operators import tiles

    rng = np.random.default_rng(1)
    pictures = {1: rng.integers(0, 255, (7, 10)), 2: rng.integers(0, 255, (1, 13)), 3: rng.integers(0, 255, (9, 4))}
    df = spark.createDataFrame([(k, p.shape[1], p.shape[0], p.ravel().tolist()) for k, p in pictures.items()] + [(4, 3, 3, [1]), (5, 0, 0, [])], "picture long, width int, height int, pixels array<long>")
    whole = lambda d, n: np.array([r["v"] for r in sorted(d.filter(F.col("picture") == n).collect(), key=lambda r: r["i"])])
    for size in (1, 3, 4, 20):
        cut = tiles.cut_tiles(df, size)
        for angle in (0, 90, 180, 270, -90, 450):
            turned = tiles.join_tiles(tiles.turn_tiles(cut, F.lit(angle))).cache()
            for k, p in pictures.items():
                assert (whole(turned, k) == np.rot90(p, -angle // 90).ravel()).all()
            turned.unpersist()
    cut = tiles.turn_tiles(tiles.cut_tiles(df, 3), F.lit(90))
    for w2, h2 in ((3, 3), (5, 2), (1, 1), (20, 9)):
        small = tiles.scale_tiles(cut, w2, h2).cache()
        for k, p in pictures.items():
            p = np.rot90(p, -1)
            fine = np.kron(p, np.ones((h2, w2)))
            want = fine.reshape(h2, p.shape[0], w2, p.shape[1]).mean((1, 3))
            assert np.allclose(whole(small, k), want.ravel())
        small.unpersist()


def test_digests_of_round_trips(spark):
    from sheetwright.operators import manifests

    rng = random.Random(4)
    data = [(a, f"p{k}", rng.choice([f"P{k}", None]), k, rng.choice([0, 90, None]), rng.choice(["3x3", None])) for a in range(4) for k in range(120)]
    data += data[7:9]  # repeated rows
    before = spark.createDataFrame(data, MANIFEST)
    assert manifests.differing_blocks(before, before.repartition(5), 50).count() == 0
    other = [list(r) for r in data]
    other[130][2], other[131][2] = other[131][2], other[130][2]
    other[300][4], other[300][5] = other[300][5] and 0, "4x4"
    after = spark.createDataFrame([tuple(r) for r in other[:-1]], MANIFEST)
    want = rows(manifests.roundtrip_diff(before, after))
    assert want and rows(manifests.roundtrip_diff_by_digests(before, after, 50)) == want
    assert {tuple(r) for r in manifests.differing_blocks(before, after, 50).collect()} <= {(0, 0), (1, 0), (2, 1)}
    nulls = spark.createDataFrame([(1, "a", None, 0, 5, None)], MANIFEST), spark.createDataFrame([(1, "a", None, 0, None, "5")], MANIFEST)
    assert manifests.roundtrip_diff_by_digests(*nulls).count() == 2


def test_duplicates_by_hash(spark):
    rng = random.Random(5)
    data = [(rng.randrange(3), rng.choice([f"n{rng.randrange(60)}", None]), f"P{k}", rng.randrange(20)) for k in range(300)] + [(None, "n1", "x", 1), (None, "n1", "y", 2)]
    df = spark.createDataFrame(data, BATCH)
    assert rows(photos.dedupe_keep_first_by_hash(df)) == rows(photos.dedupe_keep_first(df))
    assert rows(photos.duplicate_report_by_hash(df)) == rows(photos.duplicate_report(df))


def test_pieces_of_drags_stay_within_blocks(spark):
    from sheetwright.operators import edits
    from sheetwright.schemas import EDITS

    rng = random.Random(6)
    n, want = 900, list(range(900))
    log = [(1, k, "move", None, rng.randrange(n), rng.randrange(n)) for k in range(0, 3000, 3)]
    for _, _, _, _, a, b in log:
        want.insert(b, want.pop(a))
    start = manifest(spark, n)
    log = spark.createDataFrame(log, EDITS)
    pieces = edits.rearrangements(start, log, stretch=100, block=64)
    assert pieces.agg(F.sum("length")).first()[0] == n and pieces.agg(F.max("length")).first()[0] <= 64
    assert pieces.groupBy(F.floor(F.col("new") / 64)).count().agg(F.max("count")).first()[0] <= 64  # a row is a piece, a task a block
    got = edits.apply_moves_long(start, log, stretch=100, block=64).orderBy("pos").collect()
    assert [r["norm_path"] for r in got] == [f"p{k}" for k in want] and {r["move_error"] for r in got} == {0}
