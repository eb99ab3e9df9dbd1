"""Edits: turns and drags. A drag takes the photo out and puts it in (our choice, against a swap).

Drags are sequential in an album, but they compose: the drags of a stretch of seq make one
rearrangement, whatever the album's length and the other stretches. So stretches are worked on
in tasks of their own, and only their results are put together in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of seq in a stretch, and positions of a block.
STRETCH, BLOCK = 4_096, 1 << 16
_COLUMNS = ["album_id", "norm_path", "path", "pos", "rotation", "layout"]


def net_rotation(edits: DataFrame) -> DataFrame:
    """album_id, norm_path, rotation: the sum of all quarter turns, 0 to 270; needs no order."""
    angle = F.when(F.col("op") == "rotate_cw", 90).when(F.col("op") == "rotate_ccw", -90)
    turns = edits.withColumn("_angle", angle).filter("_angle IS NOT NULL")
    return turns.groupBy("album_id", "norm_path").agg(F.pmod(F.sum("_angle"), F.lit(360)).cast("int").alias("rotation"))


def rotate(manifest: DataFrame, edits: DataFrame) -> DataFrame:
    """The manifest with the edits' turns added."""
    turns = net_rotation(edits).withColumnRenamed("rotation", "_turn")
    rows = manifest.join(turns, ["album_id", "norm_path"], "left")
    return rows.withColumn("rotation", F.pmod(F.col("rotation") + F.coalesce("_turn", F.lit(0)), F.lit(360)).cast("int")).drop("_turn")


def move_photo(manifest: DataFrame, start: int, to: int) -> DataFrame:
    """One drag in every album: a projection. Albums too short for either position must be filtered before."""
    pos = F.col("pos")
    moved = F.when(pos == start, to)
    if start < to:
        moved = moved.when((pos > start) & (pos <= to), pos - 1)
    elif start > to:
        moved = moved.when((pos >= to) & (pos < start), pos + 1)
    return manifest.withColumn("pos", moved.otherwise(pos).cast("int"))


def _nth_stretch(edits: DataFrame, stretch: int | None = None) -> DataFrame:
    """album_id, seq, from_pos, to_pos and stretch of each drag."""
    nth = F.floor(F.col("seq") / (stretch or STRETCH)).cast("long")
    return edits.filter("op = 'move'").select("album_id", "seq", "from_pos", "to_pos", nth.alias("stretch"))


def _moves(manifest: DataFrame, edits: DataFrame, stretch: int | None = None) -> DataFrame:
    """_nth_stretch with n (photos of the album)."""
    n = manifest.groupBy("album_id").agg(F.count("*").alias("n"))
    return _nth_stretch(edits, stretch).join(n, "album_id")


def apply_moves(manifest: DataFrame, edits: DataFrame) -> DataFrame:
    """The manifest after all drags of each album in order of seq, with ``move_error``.

    For lists of up to some thousand photos, as whole orders are put together;
    apply_moves_long is for longer ones. A drag with a position outside the album
    changes nothing and is counted in move_error.
    """
    n = F.col("n").cast("int")
    move = F.struct("seq", "from_pos", "to_pos")
    moves = _moves(manifest, edits).groupBy("album_id", "stretch").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(move)).alias("_moves"))
    fits = lambda m: (m["from_pos"] >= 0) & (m["from_pos"] < n) & (m["to_pos"] >= 0) & (m["to_pos"] < n)
    start = F.struct(F.sequence(F.lit(0), n - 1).alias("order"), F.lit(0).alias("errors"))

    def step(state, m):
        x = F.element_at(state["order"], m["from_pos"] + 1)
        left = F.concat(F.slice(state["order"], 1, m["from_pos"]), F.slice(state["order"], m["from_pos"] + 2, n))
        moved = F.concat(F.slice(left, 1, m["to_pos"]), F.array(x), F.slice(left, m["to_pos"] + 1, n))
        return F.when(fits(m), F.struct(moved.alias("order"), state["errors"].alias("errors"))).otherwise(
            F.struct(state["order"].alias("order"), (state["errors"] + 1).alias("errors"))
        )

    folded = moves.withColumn("_end", F.aggregate("_moves", start, step)).select("album_id", "stretch", "n", "_end.order", "_end.errors")
    parts = folded.groupBy("album_id").agg(
        F.first("n").alias("n"), F.sum("errors").cast("int").alias("move_error"), F.sort_array(F.collect_list(F.struct("stretch", "order"))).alias("_parts")
    )
    after = F.aggregate("_parts", F.sequence(F.lit(0), n - 1), lambda acc, p: F.transform(p["order"], lambda i: F.element_at(acc, i + 1)))
    ends = parts.select("album_id", "move_error", F.posexplode(after).alias("_to", "pos"))
    rows = manifest.select(*_COLUMNS).join(ends, ["album_id", "pos"], "left")
    pos = F.coalesce("_to", "pos").alias("pos")
    return rows.select("album_id", "norm_path", "path", pos, "rotation", "layout", F.coalesce("move_error", F.lit(0)).alias("move_error"))


# A rearrangement as pieces: stretches (start, length) of the old list in the order of the new one. As rows, a piece
# is (album_id, stretch, new, old, length): the positions new, new+1, ... hold what was at old, old+1, ...

_PIECES = "album_id long, stretch long, new long, old long, length long"


def _fits() -> Column:
    """Whether a drag's positions are in its album."""
    return F.coalesce(F.col("from_pos").between(0, F.col("n") - 1) & F.col("to_pos").between(0, F.col("n") - 1), F.lit(False))


def _drags(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """drag, new, old, length: the pieces of drags from a to b, other than a, in lists of n, in the order of drag and new."""
    down, low, high = a < b, np.minimum(a, b), np.maximum(a, b)
    zero, one = np.zeros_like(n), np.ones_like(n)
    new = np.stack([zero, low, np.where(down, b, b + 1), high + 1], 1).ravel()
    old = np.stack([zero, np.where(down, a + 1, a), np.where(down, a, b), high + 1], 1).ravel()
    length = np.stack([low, np.where(down, b - a, one), np.where(down, one, a - b), n - high - 1], 1).ravel()
    some = length > 0
    return np.repeat(np.arange(len(n)), 4)[some], new[some], old[some], length[some]


def _folded(group: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """group, new, old, length: the pieces of all drags of each group, which stand in their order; n: photos of their album.

    Neighbouring rearrangements of a group are overlaid pair by pair, those of all groups at once: each pair has a range
    of its own in one long list, the lists between the two laid end to end.
    """
    parts = np.bincount(group)  # rearrangements of each group
    drag, new, old, length = _drags(n, a, b)
    nth, group, n = (np.arange(len(group)) - (np.cumsum(parts) - parts)[group])[drag], group[drag], n[drag]
    while parts.max() > 1:
        late, nth, parts = nth % 2 == 1, nth // 2, (parts + 1) // 2
        pair = (np.cumsum(parts) - parts)[group] + nth
        size = np.zeros(parts.sum(), np.int64)
        size[pair] = n
        base = np.cumsum(size) - size
        both = np.zeros(len(size), bool)
        both[pair[late]] = True
        first = np.flatnonzero(both[pair] & ~late)
        then = np.flatnonzero(late)
        then = then[np.argsort(base[pair[then]] + old[then])]
        at, by = base[pair[first]] + new[first], base[pair[then]] + old[then]
        x = np.union1d(at, by)
        i = np.searchsorted(at, x, "right") - 1
        j = np.searchsorted(by, x, "right") - 1
        i, j, i_off, j_off = first[i], then[j], x - at[i], x - by[j]
        end = (base + size)[pair[i]]
        alone = np.flatnonzero(~both[pair])
        kept = np.r_[alone, i]
        new, old = np.r_[new[alone], new[j] + j_off], np.r_[old[alone], old[i] + i_off]
        length = np.r_[length[alone], np.minimum(np.append(x[1:], end[-1:]), end) - x]
        order = np.argsort(base[pair[kept]] + new)
        pair, kept, new, old, length = pair[kept][order], kept[order], new[order], old[order], length[order]
        start = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (old[1:] != old[:-1] + length[:-1])])
        length = np.add.reduceat(length, start)
        kept, new, old = kept[start], new[start], old[start]
        group, nth, n = group[kept], nth[kept], n[kept]
    return group, new, old, length


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pieces of each album's stretch, from its drags in their order; a stretch may go on in the next batch."""

    def pieces(moves: pd.DataFrame) -> pd.DataFrame:
        key = moves[["album_id", "stretch"]].to_numpy()
        begins = np.r_[True, (key[1:] != key[:-1]).any(axis=1)]
        group, new, old, length = _folded(np.cumsum(begins) - 1, *(moves[c].to_numpy(np.int64) for c in ("n", "from_pos", "to_pos")))
        key = key[begins][group]
        return pd.DataFrame({"album_id": key[:, 0], "stretch": key[:, 1], "new": new, "old": old, "length": length})

    rest: list[pd.DataFrame] = []  # the begun stretch
    for batch in filter(len, batches):
        last = (batch[["album_id", "stretch"]] == batch[["album_id", "stretch"]].iloc[-1]).all(axis=1).to_numpy()
        same = rest and (rest[0][["album_id", "stretch"]].iloc[0] == batch[["album_id", "stretch"]].iloc[-1]).all()
        if not same and len(done := pd.concat([*rest, batch[~last]])):
            yield pieces(done)
        rest = [*(rest if same else []), batch[last]]
    if rest:
        yield pieces(pd.concat(rest))


def _cut_at_blocks(pieces: DataFrame, at: Column, block: int) -> DataFrame:
    """Adds block; a piece over several blocks of positions ``at`` becomes one for each."""
    first, last = (at / block).cast("long"), ((at + F.col("length") - 1) / block).cast("long")
    each = pieces.withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(at, F.col("block") * block)
    size = F.least(at + F.col("length"), (F.col("block") + 1) * block) - low
    return each.withColumns({"new": F.col("new") + (low - at), "old": F.col("old") + (low - at), "length": size})


def _overlaid(pairs: DataFrame, block: int) -> DataFrame:
    """The pieces of each pair of neighbouring rearrangements (side 0, then 1), by blocks of the list between them.

    Where either side has a border in that list there is one of the result; the last piece of each side
    that began up to there tells where it comes from and where it goes. A pair's one side alone stays as it is.
    """
    between = F.when(F.col("side") == 0, F.col("new")).otherwise(F.col("old"))
    cut = _cut_at_blocks(pairs, between, block).withColumn("x", between)
    blocks = Window.partitionBy("album_id", "stretch", "block")
    so_far = blocks.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shift = lambda side, to: F.coalesce(F.last(F.when(F.col("side") == side, to - F.col("x")), ignorenulls=True).over(so_far), F.lit(0))
    old, new = F.col("x") + shift(0, F.col("old")), F.col("x") + shift(1, F.col("new"))
    end = F.coalesce(F.lead("x").over(blocks.orderBy("x")), F.col("x") + F.col("length"))
    rows = cut.select("album_id", "stretch", "block", new.alias("new"), old.alias("old"), (end - F.col("x")).alias("length")).filter("length > 0")
    # pieces that follow each other in both lists become one
    order = blocks.orderBy("new")
    follows = (F.lag(F.col("new") + F.col("length")).over(order) == F.col("new")) & (F.lag(F.col("old") + F.col("length")).over(order) == F.col("old"))
    runs = rows.withColumn("_begins", F.when(follows, 0).otherwise(1))
    runs = runs.withColumn("_run", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = runs.groupBy("album_id", "stretch", "block", "_run").agg(F.min("new").alias("new"), F.min("old").alias("old"), F.sum("length").alias("length"))
    return joined.select("album_id", "stretch", "new", "old", "length")


def rearrangements(manifest: DataFrame, edits: DataFrame, stretch: int | None = None, block: int | None = None) -> DataFrame:
    """album_id, stretch (0), new, old, length: the pieces of all drags of each album with any that moves a photo, a row a piece.

    The drags of a stretch of seq are folded in a task, those of many short stretches at once. Two neighbouring stretches are then
    put together, level by level: the list between them is cut into blocks of positions, and each block of each pair is overlaid in
    windows of its own, so that neither a row nor a window holds more than a block's pieces, whatever the album and its drags.
    """
    block = block or BLOCK
    bounds = _nth_stretch(edits, stretch).agg(F.min("stretch"), F.max("stretch")).first()
    low, spread = bounds[0] or 0, (bounds[1] or 0) - (bounds[0] or 0)
    nth = F.coalesce(F.col("stretch") - low, F.lit(0)).alias("stretch")  # drags without seq come first
    moves = _moves(manifest, edits, stretch).filter(_fits() & (F.col("from_pos") != F.col("to_pos"))).select("album_id", nth, "seq", "n", "from_pos", "to_pos")
    dealt = moves.repartition("album_id", "stretch").sortWithinPartitions("album_id", "stretch", "seq", "from_pos", "to_pos")
    parts = dealt.drop("seq").mapInPandas(_fold, _PIECES)
    while spread > 0:
        side, pair = (F.col("stretch") % 2).cast("int"), F.floor(F.col("stretch") / 2).cast("long")
        parts = _overlaid(parts.withColumns({"side": side, "stretch": pair}), block)
        spread //= 2
    return parts


def apply_moves_long(manifest: DataFrame, edits: DataFrame, stretch: int | None = None, block: int | None = None) -> DataFrame:
    """apply_moves for albums of any length: no row, window or batch holds an album's list, or all its drags or their pieces.

    stretch: values of seq whose drags are folded in one task; block: positions that are worked on in one window.
    """
    block = block or BLOCK
    pieces = _cut_at_blocks(rearrangements(manifest, edits, stretch, block), F.col("old"), block)
    piece = F.struct((F.col("old") + F.col("length")).alias("end"), (F.col("new") - F.col("old")).alias("shift")).alias("_piece")
    cells = manifest.select(*_COLUMNS, F.floor(F.col("pos") / block).cast("long").alias("_block"), F.col("pos").cast("long").alias("_at"), F.lit(True).alias("_cell"))
    rows = cells.unionByName(pieces.select("album_id", F.col("block").alias("_block"), F.col("old").alias("_at"), piece), allowMissingColumns=True)
    so_far = Window.partitionBy("album_id", "_block").orderBy("_at", F.col("_cell").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = rows.withColumn("_piece", F.last("_piece", ignorenulls=True).over(so_far)).filter("_cell")
    moved = F.when(F.col("_at") < F.col("_piece.end"), F.col("_at") + F.col("_piece.shift")).otherwise(F.col("pos")).cast("int")
    placed = last.withColumn("pos", moved).select(*_COLUMNS)
    errors = _moves(manifest, edits).groupBy("album_id").agg(F.count_if(~_fits()).cast("int").alias("move_error"))
    return placed.join(errors, "album_id", "left").withColumn("move_error", F.coalesce("move_error", F.lit(0)))
