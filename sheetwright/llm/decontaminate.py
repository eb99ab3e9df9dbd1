"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, then an exact check.

Windows are all stretches of 10 consecutive words of an item (an item of fewer words is one window). A
window is taken as the set of its shingles (5 words with their places; a shorter window is one shingle), and it
is in a document if all of them are. At containment 1 the necessary prefix is the first shingle of a global order, so
that shingles are ordered by rarity: one pass over the documents finds where shingles of any window
stand (``postings``) and counts them, and only the rarest of each window is joined with the postings.
A hit at word i of a document puts the window's start at i - j; it has to be within the document
(the bounds on position and length). Starts that are left are compared word by word with the window.

The windows' shingles and prefixes are written tables, of which Spark knows the size: it broadcasts them below
spark.sql.autoBroadcastJoinThreshold and shuffles beyond it, without change of results. Text isn't carried
along with its shingles: documents are numbered and written once, and only those with a candidate meet their
text again. A passage in very many documents is a key of the join with the windows alone; all else is
keyed by document. Texts are shuffled for the check only where a broadcast table of at most CELLS cells, to which
row numbers are hashed, says that the document may have a candidate. DataFrame functions only.

Edge cases: null and empty texts have no words, are never hit and make no window; an item's text that repeats is
one window of several items; rows that repeat an item_id are one item; a null item_id counts as the empty id; each
document row gives one row, and only doc_id and text are read; empty tables on either side give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, text_or_empty

WINDOW, SHINGLE = 10, 5
#: Cells of the table that keeps most texts out of the check's shuffle: at most 8 MB, whatever the input. It decides no result.
CELLS = 1 << 20
#: All ASCII characters but digits and letters a-z, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(body: Column) -> Column:
    """The words of a lower-cased text."""
    return F.array_remove(F.split(body, SEPARATORS), "")


def stretches(items: Column, size: int, make) -> Column:
    """make(stretch, place) of each ``size`` consecutive elements; empty where there are fewer."""
    places = F.when(F.size(items) >= size, F.sequence(F.lit(0), F.size(items) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: make(F.slice(items, i + 1, size), i))


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(w, item): each window of each item once; w: array of words, item: its id as text."""
    rows = items.select(text_or_empty(F.col("item_id")).alias("item"), words(ascii_lower(text_or_empty(F.col("text")))).alias("ws"))
    whole = F.when(F.size("ws") > 0, F.array("ws")).otherwise(F.array().cast("array<array<string>>"))
    windows = F.when(F.size("ws") < size, whole).otherwise(stretches(F.col("ws"), size, lambda w, _: w))
    return rows.select("item", F.explode(windows).alias("w")).distinct()


def shingles(ws: Column, size: int) -> Column:
    """Array of (at, key) of the shingles of ``size`` words."""
    return stretches(ws, size, lambda s, i: F.struct(i.alias("at"), F.xxhash64(s).alias("key")))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of a window), items (sorted ids as text, null without any)."""
    body = ascii_lower(text_or_empty(F.col("text")))
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", body.alias("body"))
    docs = cut(docs.withColumn("n_words", F.size(words(F.col("body"))).cast("long")), "contamination-docs")
    held = cut(item_windows(items, window), "contamination-items")
    windows = cut(held.select("w").distinct().select(F.monotonically_increasing_id().alias("window"), "w"), "contamination-windows")

    of = F.least(F.size("w"), F.lit(shingle))
    sizes = sorted(r[0] for r in windows.select(of.alias("s")).distinct().collect())  # at most ``shingle`` numbers
    parts = windows.select("window", F.size("w").alias("len"), F.inline(F.concat(*(F.when(of == s, shingles(F.col("w"), s)).otherwise(shingles(F.array().cast("array<string>"), s)) for s in sizes or [1]))))
    parts = cut(parts.select("window", "len", F.col("at").alias("j"), "key"), "contamination-parts")
    ws = words(F.col("body"))
    text = docs.select("row", "n_words", ws.alias("ws"))
    spread = text.select("row", "n_words", F.inline(F.concat(*(shingles(F.col("ws"), s) for s in sizes or [1]))))
    postings = cut(spread.join(parts.select("key").distinct(), "key", "left_semi"), "contamination-postings")

    counts = postings.groupBy("key").agg(F.count("*").alias("n"))
    rarest = parts.join(counts, "key", "left").groupBy("window", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "j")).alias("p"))
    prefix = cut(rarest.filter("p.n > 0").select("window", "len", "p.key", "p.j"), "contamination-prefixes")
    start = F.col("at") - F.col("j")
    fits = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    hits = postings.join(prefix, "key").filter(fits).select("row", F.struct(start.alias("start"), "len", "window").alias("c"))
    lists = cut(hits.groupBy("row").agg(F.collect_list("c").alias("cs")), "contamination-candidates")

    cell = F.xxhash64("row").bitwiseAND(F.lit(CELLS - 1))
    cells = cut(lists.select(cell.alias("cell")).distinct(), "contamination-cells")
    near = docs.select("row", "body", cell.alias("cell")).join(cells, "cell", "left_semi")
    there = near.join(lists.hint("merge"), "row").select("row", words(F.col("body")).alias("ws"), "cs")
    there = there.select("row", F.inline(F.transform("cs", lambda c: F.struct(c["start"].alias("start"), c["window"].alias("window"), F.slice("ws", c["start"] + 1, c["len"]).alias("w")))))
    exact = there.join(windows.withColumnRenamed("w", "known"), "window").filter(F.col("w") == F.col("known"))
    exact = cut(exact.select("row", "start", F.size("w").alias("len"), "window"), "contamination-hits")

    spans = F.array_sort(F.collect_set(F.struct("start", "len")))
    covered = exact.groupBy("row").agg(spans.alias("spans")).select("row", n_covered(F.col("spans")).alias("n_hit"))
    named = exact.select("row", "window").distinct().join(held.join(windows, "w").select("window", "item"), "window")
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = cut(covered.join(named, "row"), "contamination-found")
    return docs.select("row", "doc_id", "n_words").join(found.hint("merge"), "row", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), "items")


def n_covered(spans: Column) -> Column:
    """The number of places in a sorted array of (start, len)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("stop"))

    def add(acc, s):
        stop = F.greatest(acc["stop"], s["start"] + s["len"])
        return F.struct((acc["n"] + (stop - F.greatest(acc["stop"], s["start"])).cast("long")).alias("n"), stop.alias("stop"))

    return F.aggregate(spans, zero, add, lambda acc: acc["n"])
