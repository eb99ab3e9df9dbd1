"""The registered queries of the photo operators, each with its SQL where SQL can express it.

queries on files make files of the given tables and are held against the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, paths, rasters
from ..functions.state import manifest_json, parse_manifest
from ..operators import edits, manifests, pages, photos
from ..operators.layouts import with_layout
from ..session import shared_dir as spark_dir
from . import fixtures as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


CELLS = "album_id, norm_path, pos, rotation, layout, page_no, slot, \"row\", col"
_cells = ["album_id", "norm_path", "pos", "rotation", "layout", "page_no", "slot", "row", "col"]


# Flagship: photos -> first copies -> numbers -> pages


@query(f"""WITH {X.MANIFEST_SQL} SELECT album_id, layout, count(*) AS n_photos, CAST(max(page_no) + 1 AS BIGINT) AS n_pages FROM cells GROUP BY ALL""")
def a1_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_count(X.manifest(spark, sf_dir))


@query(f"WITH {X.PHOTOS_SQL} SELECT album_id, norm_path, path, src_seq FROM first")
def w1_dedupe_keep_first(spark, sf_dir):
    return photos.dedupe_keep_first(X.photos(spark, sf_dir)).select("album_id", "norm_path", "path", "src_seq")


@query(f"WITH {X.PHOTOS_SQL} SELECT album_id, norm_path, pos FROM listed")
def w2_number_photos(spark, sf_dir):
    return photos.number_photos(photos.dedupe_keep_first(X.photos(spark, sf_dir))).select("album_id", "norm_path", "pos")


@query(f"WITH {X.PHOTOS_SQL} SELECT album_id, norm_path, pos FROM listed")
def w2_number_albums(spark, sf_dir):
    spark_dir(spark)
    return photos.number_albums(photos.dedupe_keep_first(X.photos(spark, sf_dir))).select("album_id", "norm_path", "pos")


@query(f"WITH {X.MANIFEST_SQL} SELECT {CELLS} FROM cells")
def w3_paginate(spark, sf_dir):
    return pages.paginate(X.manifest(spark, sf_dir)).select(*_cells)


@query(f"""WITH {X.PHOTOS_SQL}, one AS (SELECT norm_path, min(src_seq) AS src_seq FROM photos GROUP BY 1)
SELECT norm_path, CAST(row_number() OVER (ORDER BY src_seq, norm_path) - 1 AS BIGINT) AS pos FROM one""")
def w4_number_global(spark, sf_dir):
    spark_dir(spark)
    one = X.photos(spark, sf_dir).groupBy("norm_path").agg(F.min("src_seq").alias("src_seq"))
    return photos.number_global(one, ["src_seq", "norm_path"]).select("norm_path", "pos")


# Projections and filters


@query(f"""WITH {X.PATHS_SQL} SELECT path FROM paths WHERE lower(regexp_extract(path, '\\.([^.]+)$', 1)) IN ('jpg', 'jpeg', 'png', 'bmp', 'gif', 'tiff', 'webp')""")
def p1_keep_supported(spark, sf_dir):
    return photos.keep_supported(X.paths(spark, sf_dir))


@query(f"""WITH {X.PATHS_SQL} SELECT path, CASE WHEN lower(regexp_extract(path, '\\.([^.]+)$', 1)) IN ('jpg', 'jpeg', 'png', 'bmp', 'gif', 'tiff', 'webp') THEN 'image'
WHEN lower(regexp_extract(path, '\\.([^.]+)$', 1)) = 'pdf' THEN 'pdf' ELSE 'other' END AS media FROM paths""")
def p2_classify_media(spark, sf_dir):
    return photos.classify_media(X.paths(spark, sf_dir))


@query(f"""WITH {X.PATHS_SQL} SELECT path, lower(regexp_replace(regexp_replace(regexp_replace(replace(path, '\\', '/'), '/+', '/', 'g'), '/tmp/\\.\\./', '/'), '/\\./', '/')) AS norm_path FROM paths""")
def p3_normalize_path(spark, sf_dir):
    return X.paths(spark, sf_dir).select("path", paths.normalize_path(F.col("path")).alias("norm_path"))


@query(f"WITH {X.MANIFEST_SQL} SELECT {CELLS} FROM cells WHERE album_id = 7 AND page_no = 2")
def p5_page_view(spark, sf_dir):
    return pages.page_view(pages.paginate(X.manifest(spark, sf_dir)), 7, 2).select(*_cells)


@query(f"""WITH {X.MANIFEST_SQL} SELECT album_id, norm_path, page_no, slot, "row", col FROM cells WHERE norm_path = (SELECT min(norm_path) FROM photos)""")
def p6_locate_photo(spark, sf_dir):
    cells = pages.paginate(X.manifest(spark, sf_dir))
    return pages.locate_photo(cells, X.photos(spark, sf_dir).agg(F.min("norm_path")).first()[0])


@query(f"""WITH {X.PATHS_SQL} SELECT path, regexp_extract(path, '([^/\\\\]*)$', 1) AS name, lower(regexp_extract(path, '\\.([^.]+)$', 1)) AS ext FROM paths""")
def f9_file_parts(spark, sf_dir):
    path = F.col("path")
    return X.paths(spark, sf_dir).select("path", paths.file_name(path).alias("name"), paths.file_ext(path).alias("ext"))


@query(ORACLES["p5_page_view"])
def p5_page_lookup(spark, sf_dir):
    from ..sources import lookup

    lookup.write_cells(pages.paginate(X.manifest(spark, sf_dir)), path := f"{spark_dir(spark)}/sheetwright/cells-{uuid.uuid4().hex}")
    return lookup.page_photos(spark, path, [(7, 2)]).select(*_cells)


@query(f"""WITH {X.MANIFEST_SQL} SELECT album_id, norm_path, page_no, slot, "row", col FROM cells WHERE norm_path IN ((SELECT min(norm_path) FROM photos), (SELECT max(norm_path) FROM photos))""")
def p6_photo_lookup(spark, sf_dir):
    from ..sources import lookup

    lookup.write_cells(pages.paginate(X.manifest(spark, sf_dir)), path := f"{spark_dir(spark)}/sheetwright/cells-{uuid.uuid4().hex}")
    ends = X.photos(spark, sf_dir).agg(F.min("norm_path"), F.max("norm_path")).first()
    return lookup.photo_places(spark, path, list(ends)).select("album_id", "norm_path", "page_no", "slot", "row", "col")


# Joins and set operations


@query(f"""WITH {X.MANIFEST_SQL}, old AS (SELECT * FROM manifest WHERE album_id % 2 = 0 AND pos % 3 <> 1), dense AS (SELECT album_id, norm_path, path,
  CAST(row_number() OVER (PARTITION BY album_id ORDER BY pos) - 1 AS INTEGER) AS pos, rotation, layout FROM old),
fresh AS (SELECT first.* FROM first ANTI JOIN dense USING (album_id, norm_path)),
ends AS (SELECT album_id, max(pos) AS m, any_value(layout) AS layout FROM dense GROUP BY 1)
SELECT album_id, norm_path, path, pos, rotation, layout FROM dense UNION ALL
SELECT album_id, norm_path, path, CAST(coalesce(m, -1) + row_number() OVER (PARTITION BY album_id ORDER BY src_seq, norm_path) AS INTEGER), 0, layout FROM fresh LEFT JOIN ends USING (album_id)""")
def j1_add_photos(spark, sf_dir):
    old = X.manifest(spark, sf_dir).filter("album_id % 2 = 0 AND pos % 3 <> 1")
    dense = old.withColumn("pos", (F.expr("row_number() OVER (PARTITION BY album_id ORDER BY pos)") - 1).cast("int"))
    return photos.add_photos(dense, X.photos(spark, sf_dir))


@query(f"""WITH {X.MANIFEST_SQL} SELECT p.album_id, p.norm_path, p.path, m.pos, coalesce(m.rotation, 0) AS rotation, m.layout
FROM first p LEFT JOIN (SELECT * FROM manifest WHERE pos % 2 = 0) m USING (album_id, norm_path)""")
def j2_apply_state(spark, sf_dir):
    rows = photos.apply_state(photos.dedupe_keep_first(X.photos(spark, sf_dir)), X.manifest(spark, sf_dir).filter("pos % 2 = 0"))
    return rows.select("album_id", "norm_path", "path", "pos", "rotation", "layout")


def _orders(spark, sf_dir):
    """Manifest entries are the orders with lines; files on disk are the orders of status F."""
    listed = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("string").alias("norm_path")).distinct()
    there = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("norm_path"))
    return listed, there


_ORDERS = """WITH listed AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS norm_path FROM lineitem),
there AS (SELECT CAST(o_orderkey AS VARCHAR) AS norm_path FROM orders WHERE o_orderstatus = 'F') """


@query(_ORDERS + "SELECT norm_path, norm_path IN (SELECT norm_path FROM there) AS found FROM listed")
def j3_resolve_originals(spark, sf_dir):
    return photos.resolve_originals(*_orders(spark, sf_dir))


@query(_ORDERS + "SELECT norm_path FROM listed ANTI JOIN there USING (norm_path)")
def j4_missing_originals(spark, sf_dir):
    return photos.missing_originals(*_orders(spark, sf_dir))


@query(_ORDERS + "SELECT norm_path FROM listed SEMI JOIN there USING (norm_path)")
def j4_present_originals(spark, sf_dir):
    return photos.present_originals(*_orders(spark, sf_dir))


@query(f"WITH {X.MANIFEST_SQL} SELECT album_id, norm_path, layout, rows, cols, capacity FROM cells")
def j5_with_layout(spark, sf_dir):
    return with_layout(X.manifest(spark, sf_dir)).select("album_id", "norm_path", "layout", "rows", "cols", "capacity")


@query(_ORDERS + "SELECT norm_path, CAST(NULL AS VARCHAR) AS src_pdf FROM there UNION ALL SELECT norm_path || '#p0i0', norm_path FROM listed")
def u1_union_sources(spark, sf_dir):
    listed, there = _orders(spark, sf_dir)
    split = listed.select(F.concat("norm_path", F.lit("#p0i0")).alias("norm_path"), F.col("norm_path").alias("src_pdf"))
    return photos.union_sources(there, split)


@query(f"""WITH {X.MANIFEST_SQL} SELECT album_id, path, pos, rotation, layout, 'before' AS side FROM manifest WHERE rotation = 90
UNION ALL SELECT album_id, path, pos, 270, layout, 'after' FROM manifest WHERE rotation = 90""")
def u2_roundtrip_diff(spark, sf_dir):
    before = X.manifest(spark, sf_dir)
    after = manifests.unpack_manifest(manifests.pack_manifest(before.withColumn("rotation", F.when(F.col("rotation") == 90, 270).otherwise(F.col("rotation")))))
    return manifests.roundtrip_diff(before, after)


@query(f"WITH {X.MANIFEST_SQL} SELECT album_id, norm_path, path, pos, rotation, layout FROM manifest")
def s4_manifest_table(spark, sf_dir):
    from ..sources.tables import read_manifest, write_manifest

    path = f"{spark_dir(spark)}/sheetwright/manifest-{uuid.uuid4().hex}"
    write_manifest(X.manifest(spark, sf_dir), path)
    return read_manifest(spark, path)


_J1 = ORACLES["j1_add_photos"]


@query(f"""SELECT album_id, norm_path, path, pos, CAST(CASE WHEN pos % 10 = 3 THEN (rotation + 90) % 360 ELSE rotation END AS INTEGER) AS rotation, layout
FROM ({_J1}) WHERE pos % 10 <> 7""")
def s4_snapshot_table(spark, sf_dir):
    """Four commits: a list, a batch added, the same batch delivered again, an edit of some photos that takes others out."""
    from ..sources.snapshots import ManifestTable

    old = X.manifest(spark, sf_dir).filter("album_id % 2 = 0 AND pos % 3 <> 1")
    table = ManifestTable(spark, f"{spark_dir(spark)}/sheetwright/manifest-{uuid.uuid4().hex}")
    table.replace(old.withColumn("pos", (F.expr("row_number() OVER (PARTITION BY album_id ORDER BY pos)") - 1).cast("int")))
    for _ in range(2):
        table.add(X.photos(spark, sf_dir), ("photos", 1))
    some = table.read().filter("pos % 10 IN (3, 7)").withColumn("rotation", ((F.col("rotation") + 90) % 360).cast("int"))
    table.change(some, F.col("pos") % 10 == 7)
    return table.read()


@query("""WITH old AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderkey % 97 AS length FROM orders WHERE o_orderstatus IN ('F', 'P')),
new AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderkey % 97 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS length FROM orders WHERE o_orderstatus IN ('O', 'P')),
sides AS (SELECT path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'gone' WHEN old.length <> new.length THEN 'changed' END AS change,
  coalesce(new.length, old.length) AS length FROM old FULL JOIN new USING (path))
SELECT path, change, length FROM sides WHERE change IS NOT NULL""")
def s1_listing_changes(spark, sf_dir):
    from ..sources.scan import listing_changes

    files = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderkey").alias("k"), "o_orderstatus", F.lit(None).cast("timestamp").alias("modificationTime"))
    old = files.filter("o_orderstatus IN ('F', 'P')").withColumn("length", F.col("k") % 97)
    new = files.filter("o_orderstatus IN ('O', 'P')").withColumn("length", F.col("k") % 97 + F.when(F.col("k") % 5 == 0, 1).otherwise(0))
    return listing_changes(old, new).select("path", "change", "length")


@query(f"""WITH {X.MANIFEST_SQL} SELECT album_id, path, pos, rotation, layout, 'before' AS side FROM manifest WHERE album_id % 5 = 1 AND pos % 400 = 7
UNION ALL SELECT album_id, path, pos, (rotation + 90) % 360, layout, 'after' FROM manifest WHERE album_id % 5 = 1 AND pos % 400 = 7""")
def u2_roundtrip_diff_by_digests(spark, sf_dir):
    before = X.manifest(spark, sf_dir)
    turned = F.when((F.col("album_id") % 5 == 1) & (F.col("pos") % 400 == 7), (F.col("rotation") + 90) % 360).otherwise(F.col("rotation"))
    after = manifests.unpack_manifest(manifests.pack_manifest(before.withColumn("rotation", turned.cast("int"))))
    return manifests.roundtrip_diff_by_digests(before, after, block=100)


@query(ORACLES["w1_dedupe_keep_first"])
def w1_dedupe_by_hash(spark, sf_dir):
    return photos.dedupe_keep_first_by_hash(X.photos(spark, sf_dir)).select("album_id", "norm_path", "path", "src_seq")


# Aggregations


@query(f"WITH {X.PHOTOS_SQL} SELECT album_id, norm_path, count(*) AS copies, count(*) - 1 AS skipped FROM photos GROUP BY ALL HAVING count(*) > 1")
def a2_duplicate_report(spark, sf_dir):
    return photos.duplicate_report(X.photos(spark, sf_dir))


@query(ORACLES["a2_duplicate_report"])
def a2_duplicate_report_by_hash(spark, sf_dir):
    return photos.duplicate_report_by_hash(X.photos(spark, sf_dir))


@query("""WITH albums AS (SELECT source AS album_id, count(*) AS n FROM documents GROUP BY 1),
grids(layout, capacity) AS (VALUES ('1x1', 1), ('2x2', 4), ('2x3', 6), ('3x2', 6), ('3x3', 9), ('3x4', 12), ('4x3', 12), ('4x4', 16))
SELECT album_id, layout, CAST((n + capacity - 1) // capacity AS BIGINT) AS n_pages, CAST((n + capacity - 1) // capacity * capacity - n AS BIGINT) AS n_blank FROM albums CROSS JOIN grids""")
def a3_compare_layouts(spark, sf_dir):
    return pages.compare_layouts(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("album_id")))


@query(f"""WITH {X.EDITS_SQL} SELECT album_id, norm_path, CAST(((sum(CASE op WHEN 'rotate_cw' THEN 90 ELSE -90 END) % 360) + 360) % 360 AS INTEGER) AS rotation
FROM edits WHERE op <> 'move' GROUP BY ALL""")
def a4_net_rotation(spark, sf_dir):
    return edits.net_rotation(X.edits(spark, sf_dir))


_PACK = f"""WITH {X.MANIFEST_SQL} SELECT album_id, CAST(pos // 24000 AS INTEGER) AS block, '{{"album_id":' || CAST(album_id AS VARCHAR) || coalesce(',"layout":"' || any_value(layout) || '"', '') || ',"cells":[' ||
string_agg('{{"pos":' || CAST(pos AS VARCHAR) || ',"path":"' || path || '","rotation":' || CAST(rotation AS VARCHAR) || '}}', ',' ORDER BY pos) || ']}}' AS state FROM manifest GROUP BY album_id, pos // 24000"""


@query(_PACK)
def a5_pack_manifest(spark, sf_dir):
    return manifests.pack_manifest(X.manifest(spark, sf_dir))


@query(f"WITH {X.MANIFEST_SQL} SELECT album_id, path, pos, rotation, layout FROM manifest")
def a5_state_sink(spark, sf_dir):
    from ..sources.states import read_states, write_states

    path = f"{spark_dir(spark)}/sheetwright/states-{uuid.uuid4().hex}"
    write_states(manifests.pack_manifest(X.manifest(spark, sf_dir), F.floor(F.col("pos") / 100)), path)
    return manifests.unpack_manifest(read_states(spark, path))


@query(f"WITH {X.MANIFEST_SQL} SELECT album_id, path, pos, rotation, layout FROM manifest")
def f8_manifest_json(spark, sf_dir):
    cells = F.array(F.struct("pos", "path", "rotation"))
    text = X.manifest(spark, sf_dir).select(manifest_json(F.col("album_id"), F.col("layout"), cells).alias("state"))
    rows = text.select(parse_manifest(F.col("state")).alias("s")).select("s.album_id", "s.layout", F.explode("s.cells").alias("c"))
    return rows.select("album_id", "c.path", "c.pos", "c.rotation", "layout")


# Order


@query(f"WITH {X.MANIFEST_SQL} SELECT album_id, norm_path, pos FROM manifest ORDER BY album_id, pos")
def o1_in_order(spark, sf_dir):
    return pages.in_order(X.manifest(spark, sf_dir)).select("album_id", "norm_path", "pos")


@query(f"WITH {X.MANIFEST_SQL} SELECT {CELLS} FROM cells WHERE page_no < 2")
def o2_first_pages(spark, sf_dir):
    return pages.first_pages(pages.paginate(X.manifest(spark, sf_dir)), 2).select(*_cells)


@query(f"WITH {X.PHOTOS_SQL} SELECT album_id, norm_path, src_seq FROM listed WHERE pos < 18")
def o2_first_pages_of_list(spark, sf_dir):
    rows = photos.dedupe_keep_first(X.photos(spark, sf_dir))
    return pages.first_pages_of_list(rows, 2).select("album_id", "norm_path", "src_seq")


@query(f"""WITH {X.PHOTOS_SQL} SELECT album_id, norm_path, CAST(CASE WHEN pos = 40 THEN 5 WHEN pos >= 5 AND pos < 40 THEN pos + 1 ELSE pos END AS INTEGER) AS pos
FROM listed WHERE album_id IN (SELECT album_id FROM listed GROUP BY 1 HAVING count(*) > 40)""")
def o3_move_photo(spark, sf_dir):
    rows = X.manifest(spark, sf_dir)
    long = rows.filter("pos = 40").select("album_id")
    return edits.move_photo(rows.join(long, "album_id", "left_semi"), 40, 5).select("album_id", "norm_path", "pos")


@query(f"""WITH RECURSIVE {X.EDITS_SQL}, moves AS (SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY seq) AS k FROM edits WHERE op = 'move'),
run(album_id, k, ps) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), ['photo0', 'photo1', 'photo2', 'photo3', 'photo4', 'photo5', 'photo6', 'photo7', 'photo8'] FROM events
  UNION ALL SELECT r.album_id, m.k, list_concat(list_concat(l[1:to_pos], [x]), l[to_pos + 1:]) FROM (
    SELECT r.album_id, m.k, m.to_pos, r.ps[m.from_pos + 1] AS x, list_concat(r.ps[1:m.from_pos], r.ps[m.from_pos + 2:]) AS l
    FROM run r JOIN moves m ON m.album_id = r.album_id AND m.k = r.k + 1) r JOIN moves m ON m.album_id = r.album_id AND m.k = r.k),
done AS (SELECT album_id, arg_max(ps, k) AS ps FROM run GROUP BY 1)
SELECT album_id, unnest(ps) AS norm_path, CAST(unnest(range(9)) AS INTEGER) AS pos FROM done""".replace("SELECT r.album_id, m.k, list_concat(list_concat(l[1:to_pos], [x]), l[to_pos + 1:]) FROM (", "SELECT album_id, k, list_concat(list_concat(l[1:to_pos], [x]), l[to_pos + 1:]) FROM (").replace(") r JOIN moves m ON m.album_id = r.album_id AND m.k = r.k)", "))"))
def o4_apply_moves(spark, sf_dir):
    return edits.apply_moves(X.nine(spark, sf_dir), X.edits(spark, sf_dir)).select("album_id", "norm_path", "pos")


@query(ORACLES["o4_apply_moves"])
def o4_apply_moves_long(spark, sf_dir):
    return edits.apply_moves_long(X.nine(spark, sf_dir), X.edits(spark, sf_dir)).select("album_id", "norm_path", "pos")


@query(f"""WITH RECURSIVE {X.PHOTOS_SQL}, {X.DRAGS_SQL}, sized AS (SELECT album_id, list(norm_path ORDER BY pos) AS ps, count(*) AS n FROM listed GROUP BY 1),
run AS (SELECT album_id, CAST(0 AS BIGINT) AS k, ps FROM sized
  UNION ALL SELECT album_id, k, CASE WHEN fits THEN list_concat(list_concat(l[1:to_pos], [x]), l[to_pos + 1:]) ELSE ps END FROM (
    SELECT r.album_id, d.k, r.ps, to_pos, from_pos < len(r.ps) AND to_pos < len(r.ps) AS fits, r.ps[from_pos + 1] AS x, list_concat(r.ps[1:from_pos], r.ps[from_pos + 2:]) AS l
    FROM run r JOIN drags d ON d.album_id = r.album_id AND d.k = r.k + 1)),
done AS (SELECT album_id, arg_max(ps, k) AS ps FROM run GROUP BY 1),
wrong AS (SELECT album_id, CAST(count(*) AS INTEGER) AS move_error FROM drags JOIN sized USING (album_id) WHERE from_pos >= n OR to_pos >= n GROUP BY 1)
SELECT album_id, unnest(ps) AS norm_path, CAST(unnest(range(len(ps))) AS INTEGER) AS pos, coalesce(move_error, 0) AS move_error FROM done LEFT JOIN wrong USING (album_id)""")
def o4_apply_moves_sharded(spark, sf_dir):
    """Albums of some hundred photos and tens of drags, in several stretches, levels and blocks."""
    rows = edits.apply_moves_long(X.manifest(spark, sf_dir), X.drags(spark, sf_dir), stretch=1 << 17, block=256)
    return rows.select("album_id", "norm_path", "pos", "move_error")


# Geometry

_A4 = "72.0::DOUBLE / 25.4::DOUBLE"


@query(f"""WITH {X.SIZES_SQL}, s AS (SELECT *, least(500.0::DOUBLE / w, 700.0::DOUBLE / h) AS k FROM sizes)
SELECT l_orderkey, l_linenumber, w, h, round(k, 9) AS scale, round((500 - w * k) / 2, 6) AS x, round((700 - h * k) / 2, 6) AS y, round(w * k, 6) AS fit_w, round(h * k, 6) AS fit_h FROM s""")
def f1_fit_rect(spark, sf_dir):
    rows = X.sizes(spark, sf_dir).withColumn("r", geometry.fit_rect(F.col("w"), F.col("h"), F.lit(500.0), F.lit(700.0)))
    r = lambda c, n, d=6: F.round(F.col(f"r.{c}"), d).alias(n)
    return rows.select("l_orderkey", "l_linenumber", "w", "h", r("scale", "scale", 9), r("x", "x"), r("y", "y"), r("w", "fit_w"), r("h", "fit_h"))


@query(f"""WITH {X.MANIFEST_SQL}, s AS (SELECT *, (190.0::DOUBLE - (cols - 1) * 4) / cols AS cw, (277.0::DOUBLE - (rows - 1) * 4) / rows AS ch FROM cells)
SELECT album_id, norm_path, round((10 + col * (cw + 4)) * ({_A4}), 6) AS x, round((10 + "row" * (ch + 4)) * ({_A4}), 6) AS y, round(cw * ({_A4}), 6) AS w, round(ch * ({_A4}), 6) AS h FROM s""")
def f2_cell_rect(spark, sf_dir):
    cells = pages.paginate(X.manifest(spark, sf_dir))
    rows = cells.withColumn("r", geometry.cell_rect(F.col("row"), F.col("col"), F.col("rows"), F.col("cols")))
    return rows.select("album_id", "norm_path", *(F.round(f"r.{c}", 6).alias(c) for c in "xywh"))


@query(f"WITH {X.SIZES_SQL} SELECT l_orderkey, l_linenumber, rotation, CASE WHEN rotation % 180 = 90 THEN h ELSE w END AS w, CASE WHEN rotation % 180 = 90 THEN w ELSE h END AS h FROM sizes")
def f3_rotated_size(spark, sf_dir):
    rows = X.sizes(spark, sf_dir).withColumn("r", geometry.rotated_size(F.col("w"), F.col("h"), F.col("rotation")))
    return rows.select("l_orderkey", "l_linenumber", "rotation", "r.w", "r.h")


@query(f"""WITH {X.SIZES_SQL} SELECT l_orderkey, l_linenumber, exif, CASE WHEN exif IN (3, 4) THEN 180 WHEN exif IN (5, 8) THEN 270 WHEN exif IN (6, 7) THEN 90 ELSE 0 END AS rotation,
exif IN (2, 4, 5, 7) AS mirror, CASE WHEN exif >= 5 THEN h ELSE w END AS w, CASE WHEN exif >= 5 THEN w ELSE h END AS h FROM sizes""")
def f4_exif_upright(spark, sf_dir):
    rows = X.sizes(spark, sf_dir).withColumn("r", geometry.exif_upright(F.col("w"), F.col("h"), F.col("exif")))
    return rows.select("l_orderkey", "l_linenumber", "exif", "r.rotation", "r.mirror", "r.w", "r.h")


@query(f"""WITH {X.SIZES_SQL} SELECT l_orderkey, l_linenumber, CAST((CASE WHEN exif IN (3, 4) THEN 180 WHEN exif IN (5, 8) THEN 270 WHEN exif IN (6, 7) THEN 90 ELSE 0 END + rotation) % 360 AS INTEGER) AS turn FROM sizes""")
def f5_compose_rotation(spark, sf_dir):
    up = geometry.exif_upright(F.col("w"), F.col("h"), F.col("exif"))
    return X.sizes(spark, sf_dir).select("l_orderkey", "l_linenumber", geometry.compose_rotation(up["rotation"], F.col("rotation")).alias("turn"))


@query("""WITH e AS (SELECT vec_id, embedding, i FROM embeddings, unnest(range(64)) u(i))
SELECT vec_id, CAST(i AS INTEGER) AS i, round(CAST(embedding[CASE vec_id % 4 WHEN 0 THEN i WHEN 1 THEN (7 - i % 8) * 8 + i // 8 WHEN 2 THEN 63 - i ELSE i % 8 * 8 + 7 - i // 8 END + 1] AS DOUBLE), 6) AS v FROM e""")
def f6_rotate_raster(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    turned = rasters.rotate_raster(F.col("embedding"), F.lit(8), F.lit(8), (F.col("vec_id") % 4 * 90).cast("int"))
    return rows.select("vec_id", F.posexplode(turned).alias("i", "v")).select("vec_id", "i", F.round(F.col("v").cast("double"), 6).alias("v"))


@query("""WITH e AS (SELECT vec_id, i, (i // 8) // 2 * 4 + (i % 8) // 2 AS b, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, unnest(range(64)) u(i))
SELECT vec_id, CAST(b AS INTEGER) AS i, round(sum(v) / 4, 6) AS v FROM e GROUP BY vec_id, b""")
def f7_resize_raster(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    small = rasters.resize_raster(F.col("embedding"), F.lit(8), F.lit(8), F.lit(4), F.lit(4))
    return rows.select("vec_id", F.posexplode(small).alias("i", "v")).select("vec_id", "i", F.round("v", 6).alias("v"))


@query(ORACLES["f6_rotate_raster"].replace("SELECT vec_id, CAST(i AS INTEGER)", "SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(i AS INTEGER)"))
def f6_turn_tiles(spark, sf_dir):
    """Pictures cut into tiles of 3 x 3 and smaller ones, turned by moving the tiles."""
    from ..operators import tiles

    cut = tiles.cut_tiles(_pictures(spark, sf_dir), 3)
    turned = tiles.turn_tiles(cut, F.col("picture") % 4 * 90)
    return tiles.join_tiles(turned).select(F.col("picture").alias("vec_id"), "i", F.round(F.col("v").cast("double"), 6).alias("v"))


@query("""WITH e AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, unnest(range(64)) u(i)),
w AS (SELECT vec_id, r * 3 + c AS b, v * (least((x + 1) * 3, (c + 1) * 8) - greatest(x * 3, c * 8)) * (least((y + 1) * 3, (r + 1) * 8) - greatest(y * 3, r * 8)) AS p
  FROM e, range(3) rs(r), range(3) cs(c) WHERE least((x + 1) * 3, (c + 1) * 8) > greatest(x * 3, c * 8) AND least((y + 1) * 3, (r + 1) * 8) > greatest(y * 3, r * 8))
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(b AS INTEGER) AS i, round(sum(p) / 64, 6) AS v FROM w GROUP BY vec_id, b""")
def f7_scale_tiles(spark, sf_dir):
    """8 x 8 to 3 x 3, which doesn't divide, over tiles of 5 x 5 and smaller ones."""
    from ..operators import tiles

    small = tiles.scale_tiles(tiles.cut_tiles(_pictures(spark, sf_dir), 5), 3, 3)
    return small.select(F.col("picture").alias("vec_id"), "i", F.round("v", 6).alias("v"))


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").cast("long").alias("picture"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("embedding").alias("pixels"))
