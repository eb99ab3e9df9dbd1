import numpy as np
from conftest import DATA, rows

from sheetwright.operators.manifests import roundtrip_diff
from sheetwright.plans import fixtures, jobs
from sheetwright.schemas import EDITS
from sheetwright.sources import pdf, raster, scan


def test_folder_to_pdf_and_back_with_edits(spark, tmp_path):
    src, out, out2 = tmp_path / "src", tmp_path / "out", tmp_path / "out2"
    for k, name in enumerate(["b.PNG", "sub/a.png", "_c.png", "d [1].png", "e.txt"]):
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_bytes(raster.to_png(np.full((3 + k, 5), 10 * k, np.uint8)))
    done = jobs.folder_to_pdf(spark, str(src), str(out), layout="2x2", hidden=True).collect()
    assert [(r["n_pages"], r["n_photos"], r["n_undrawn"]) for r in done] == [(1, 4, 0)]
    manifest = jobs.reopen(spark, [done[0]["out_path"]])
    names = [r["path"].rpartition("/")[2] for r in manifest.orderBy("pos").collect()]
    assert names == ["_c.png", "b.PNG", "d [1].png", "a.png"]
    paths = {r["path"].rpartition("/")[2]: r["norm_path"] for r in manifest.collect()}
    log = spark.createDataFrame([(1, 1, "rotate_cw", paths["b.PNG"], None, None), (1, 2, "move", None, 3, 0), (1, 3, "move", None, 1, 2)], EDITS)
    edited = jobs.edit_manifest(manifest, log)
    files = scan.with_content(edited.select("path", "norm_path"))
    table = jobs.export_manifest(edited, files, str(out2))
    times = {n: (out2 / n).stat().st_mtime_ns for n in ("album-1.pdf",)}
    again = table.collect()
    assert table.count() == 1 and times == {n: (out2 / n).stat().st_mtime_ns for n in times}  # written once, by no later action
    back = jobs.reopen(spark, [again[0]["out_path"]])
    assert roundtrip_diff(edited, back).count() == 0
    got = [(r["path"].rpartition("/")[2], r["rotation"]) for r in back.orderBy("pos").collect()]
    assert got == [("a.png", 0), ("b.PNG", 90), ("_c.png", 0), ("d [1].png", 0)]


def test_foreign_photos_join_the_list(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.png").write_bytes(raster.to_png(np.arange(36, dtype=np.uint8).reshape(6, 6)))
    done = jobs.folder_to_pdf(spark, str(tmp_path / "s"), str(tmp_path / "o")).collect()
    pdfs = scan.with_content(scan.load_paths(spark, [done[0]["out_path"]]).select("path"))
    manifest = jobs.reopen(spark, [done[0]["out_path"]])
    once = jobs.add_foreign(manifest, pdfs, 1, "grid", 2, 3)
    assert rows(once, "pos") == [(k,) for k in range(7)]
    assert rows(jobs.add_foreign(once, pdfs, 1, "grid", 2, 3)) == rows(once)
    assert pdf.is_own_pdf(pdfs).first()["own"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    """Few shuffles, and scans of the needed columns only."""
    photos = fixtures.photos(spark, f"{DATA}/sf0.001")
    assert plan(jobs.list_photos(photos, even_albums=True)).count("Exchange") == 1
    assert plan(jobs.list_photos(photos)).count("Exchange") == 2
    text = plan(jobs.list_photos(photos))
    assert "l_extendedprice" not in text and "l_shipdate" in text
    from sheetwright.operators.pages import paginate
    from sheetwright.operators.photos import keep_supported

    assert plan(paginate(jobs.list_photos(photos))).count("Exchange") == 2
    assert "Exchange" not in plan(keep_supported(fixtures.paths(spark, f"{DATA}/sf0.001")))
    a = jobs.list_photos(photos).orderBy("album_id", "pos").collect()
    assert a == jobs.list_photos(photos, even_albums=True).orderBy("album_id", "pos").collect()


def test_scan_reads_no_content(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"x")
    assert "content:binary" not in plan(scan.scan_images(spark, str(tmp_path)))
