"""Manifests: an album's edit state in rows of bounded size, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.state import manifest_json, parse_manifest
from ..session import written

COLUMNS = ["album_id", "path", "pos", "rotation", "layout"]
#: Positions of the photos in one row of packed state.
BLOCK = 24_000


def pack_manifest(cells: DataFrame, block: Column | None = None) -> DataFrame:
    """album_id, block, state (JSON): a row for each block of an album, photos in order.

    block: by default BLOCK positions; so no row grows with its album.
    """
    block = F.floor(F.col("pos") / BLOCK) if block is None else block
    rows = cells.groupBy("album_id", block.cast("int").alias("block")).agg(
        F.first("layout", ignorenulls=True).alias("layout"),
        F.sort_array(F.collect_list(F.struct("pos", "path", "rotation"))).alias("cells"),
    )
    return rows.select("album_id", "block", manifest_json(F.col("album_id"), F.col("layout"), F.col("cells")).alias("state"))


def unpack_manifest(states: DataFrame) -> DataFrame:
    """album_id, path, pos, rotation, layout of each photo of ``state``."""
    rows = states.select(parse_manifest(F.col("state")).alias("s")).select("s.album_id", "s.layout", F.explode("s.cells").alias("c"))
    return rows.select("album_id", "c.path", "c.pos", "c.rotation", "layout")


def roundtrip_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of either manifest that the other lacks, with ``side``; none after a faithful round trip.

    Each side is planned once: rows count +1 and -1, and those that don't cancel out are left.
    """
    signed = before.select(*COLUMNS, F.lit(1).alias("_n")).unionByName(after.select(*COLUMNS, F.lit(-1).alias("_n")))
    left = signed.groupBy(*COLUMNS).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    side = F.when(F.col("_n") > 0, "before").otherwise("after")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n")))
    return left.select(*COLUMNS, side.alias("side"), each.alias("_k")).drop("_k")


def block_digests(manifest: DataFrame, block: int = BLOCK) -> DataFrame:
    """album_id, block, n, s1 to s4: the number of rows of a block of positions, and sums of the halves of their 128-bit hashes.

    Sums need no order and are added up before the shuffle, which takes a row a block (of each task that holds some of it).
    """
    told = [x for c in COLUMNS for x in (F.col(c), F.col(c).isNull())]  # hashes pass over nulls, so these are told apart
    h1, h2 = F.xxhash64(*told), F.xxhash64(F.lit(1), *told)
    half = lambda h: (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))
    sums = [F.sum(x).alias(f"s{k}") for k, x in enumerate((*half(h1), *half(h2)), 1)]
    return manifest.groupBy("album_id", F.floor(F.col("pos") / block).cast("long").alias("block")).agg(F.count("*").alias("n"), *sums)


def differing_blocks(before: DataFrame, after: DataFrame, block: int = BLOCK) -> DataFrame:
    """album_id, block of the blocks whose rows aren't the same, as multisets, up to a collision of 128-bit hashes."""
    sums = ["n", "s1", "s2", "s3", "s4"]
    signed = lambda df, sign: block_digests(df, block).select("album_id", "block", *((F.col(c) * sign).alias(c) for c in sums))
    both = signed(before, 1).unionByName(signed(after, -1)).groupBy("album_id", "block").agg(*(F.sum(c).alias(c) for c in sums))
    return both.filter(" OR ".join(f"{c} <> 0" for c in sums)).select("album_id", "block")


def roundtrip_diff_by_digests(before: DataFrame, after: DataFrame, block: int = BLOCK) -> DataFrame:
    """roundtrip_diff for two large manifests that are nearly the same: only rows of blocks that differ are compared.

    Equal sides shuffle their blocks' digests alone. The blocks that differ are written first, so that Spark knows their size and
    broadcasts them where they are few. Each side is read twice, so it should be a table.
    """
    differ = written(differing_blocks(before, after, block), "differing-blocks").select(F.col("album_id").alias("_album"), F.col("block").alias("_block"))
    same = F.col("album_id").eqNullSafe(F.col("_album")) & F.floor(F.col("pos") / block).cast("long").eqNullSafe(F.col("_block"))
    return roundtrip_diff(*(side.select(*COLUMNS).join(differ, same, "left_semi") for side in (before, after)))
