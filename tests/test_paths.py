from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheetwright.functions.paths import file_ext, file_name, media, normalize_path

CASES = [
    ("C:\\Photos\\a.jpg", "c:/photos/a.jpg"),
    ("c:/photos/./a.jpg", "c:/photos/a.jpg"),
    ("C:\\Photos\\tmp\\..\\A.JPG", "c:/photos/a.jpg"),
    ("C:\\\\PHOTOS\\\\a.jpg", "c:/photos/a.jpg"),
    ("C:\\..\\..\\a.jpg", "c:/a.jpg"),
    ("C:\\Photos\\", "c:/photos"),
    ("\\\\Server\\Share\\x\\..\\a.jpg", "//server/share/a.jpg"),
    ("file:///tmp/a/../b.png", "/tmp/b.png"),
    ("file:/C:/x/a.png", "c:/x/a.png"),
    ("照片/b%20c.jpg", "照片/b%20c.jpg"),
    ("../a.jpg", "../a.jpg"),
    ("", ""),
    (None, None),
]


def test_cases(spark):
    df = spark.createDataFrame(CASES, "path string, want string")
    got = df.withColumn("got", normalize_path(F.col("path")))
    assert [r for r in got.collect() if r["got"] != r["want"]] == []


def test_posix_rules_keep_case_and_backslashes(spark):
    df = spark.createDataFrame([("/A/b\\c/../D.JPG",)], "path string")
    assert rows(df.select(normalize_path(F.col("path"), windows=False))) == [("/A/D.JPG",)]


def test_base_makes_paths_absolute(spark):
    df = spark.createDataFrame([("x\\a.jpg",), ("D:\\a.jpg",)], "path string")
    assert rows(df.select(normalize_path(F.col("path"), base="C:\\Home\\"))) == [("c:/home/x/a.jpg",), ("d:/a.jpg",)]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="aB./\\ :é", max_size=20), min_size=1, max_size=30))
def test_normalising_twice_changes_nothing(spark, texts):
    df = spark.createDataFrame([("C:\\" + t,) for t in texts], "path string")
    once = df.select(normalize_path(F.col("path")).alias("p"))
    assert once.filter(normalize_path(F.col("p")) != F.col("p")).count() == 0


def test_parts_and_media(spark):
    df = spark.createDataFrame([("a/b.JPG",), ("x\\y.tar.PDF",), ("noext",), ("z.tif",), (".png",)], "path string")
    got = rows(df.select("path", file_name(F.col("path")), file_ext(F.col("path")), media(F.col("path"))))
    assert got == [
        (".png", ".png", "png", "image"),
        ("a/b.JPG", "b.JPG", "jpg", "image"),
        ("noext", "noext", "", "other"),
        ("x\\y.tar.PDF", "y.tar.PDF", "pdf", "pdf"),
        ("z.tif", "z.tif", "tif", "other"),
    ]
