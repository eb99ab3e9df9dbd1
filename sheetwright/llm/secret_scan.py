"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings.

DataFrame functions only. Positions come from cutting a text at its matches: the
matches and the pieces between them alternate, so running sums of their lengths
are the offsets, in code points.

A candidate is a maximal run of token characters of 20 or more with a digit in it.
Its character class sets the least entropy (bits a character) that some window of 20
characters must reach. The window moves by one character at a time: the counts of two
characters change, and with them two terms of the sum that gives the entropy. Candidates that
the allow-list names (uuids, plain numbers, slugs, alphabets, placeholders) give no span.

Edge cases: a null text is an empty one and has no spans; each input row gives one
row, also when rows repeat or doc_id is null; only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: The patterns of the base kinds, in the order in which kinds at one start are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_LEAST = 6

RUN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Character classes, the first that fits a candidate, and the least entropy of its best window.
CLASSES = ((r"^[0-9a-fA-F]+$", 3.0), (r"^([0-9a-z]+|[0-9A-Z]+)$", 3.5), (r"", 3.7))
#: Candidates that are no secrets.
ALLOWED = (
    r"^[0-9]+$",
    r"^(?i:[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12})$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[-_/]",
    r"(?i:example|placeholder|dummy|xxxx|changeme|0123456789|abcdefghij)",
)
#: A slug is allowed too: letters and separators, then up to four digits, and nowhere two separators side by side.
#: Two patterns without a repeated group, as Java recurses once for each round of such a group.
SLUG, SIDE_BY_SIDE = r"^[A-Za-z][A-Za-z/_=-]*[0-9]{1,4}$", r"[-_/=][-_/=]"


def _found(text: Column, pattern: str, group: int | None = None) -> Column:
    """Array of (gap, size, lead): characters before the match, its own, and those of group."""
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.zip_with(
        F.zip_with(gaps, whole, lambda g, m: F.struct(g.alias("g"), m.alias("m"))),
        part,
        lambda a, p: F.struct(
            F.length(a["g"]).alias("gap"), F.length(a["m"]).alias("size"), F.length(p).alias("part"), a["m"].alias("found")
        ),
    )
    rows = F.filter(rows, lambda r: r["size"].isNotNull())  # what follows the last match
    return F.when(text.rlike(pattern), rows)


def _ranked(found: Column, rank: int) -> Column:
    """The matches of one kind with the kind's rank and their place among the matches."""
    return F.transform(
        found, lambda r, i: F.struct(r["gap"], r["size"], r["part"], r["found"], F.lit(rank).alias("rank"), i.alias("at"))
    )


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits a character) of a window over text, 0 if it is shorter than a window.

    The state is the window, the sum of c * log2(c) over its counts c, and the least such sum
    of a whole window. A step takes from the sum what the count of the leaving character loses
    and adds what that of the entering one gains. Sums are whole numbers of 2**-40, so that they
    don't drift in long candidates.
    """
    unit = float(1 << 40)
    change = F.array(*(F.lit(round(unit * (c * math.log2(c) - (c - 1) * math.log2(max(c - 1, 1))))) for c in range(1, window + 1)))
    count = lambda w, c: F.length(w) - F.length(F.replace(w, c, F.lit("")))

    def leave(s: Column) -> Column:
        w = s["w"]
        less = F.struct(
            F.substring(w, 2, window).alias("w"),
            (s["total"] - F.element_at(change, count(w, F.substring(w, 1, 1)))).alias("total"),
            s["least"].alias("least"),
        )
        return F.when(F.length(w) == window, less).otherwise(s)

    def enter(s: Column, c: Column) -> Column:
        total = s["total"] + F.element_at(change, count(s["w"], c) + 1)
        return F.struct(F.concat(s["w"], c).alias("w"), total.alias("total"), s["least"].alias("least"))

    def note(s: Column) -> Column:
        least = F.when(F.length(s["w"]) == window, F.least(s["least"], s["total"])).otherwise(s["least"])
        return F.struct(s["w"].alias("w"), s["total"].alias("total"), least.alias("least"))

    # array(state) | transform: names a state that the next expression uses several times
    named = lambda s, f: F.element_at(F.transform(F.array(s), f), 1)
    step = lambda s, c: named(named(leave(s), lambda t: enter(t, c)), note)
    first = F.struct(F.lit("").alias("w"), F.lit(0).cast("long").alias("total"), F.lit(None).cast("long").alias("least"))
    entropy = lambda s: F.coalesce(math.log2(window) - s["least"] / (unit * window), F.lit(0.0))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), first, step, entropy)


def is_random(text: Column, window: int = WINDOW) -> Column:
    """Whether a candidate's best window reaches the entropy of its class and no allow-list entry names it."""
    least = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        least = F.when(text.rlike(pattern), F.lit(bits)).otherwise(least)
    allowed = text.rlike(SLUG) & ~text.rlike(SIDE_BY_SIDE)
    for pattern in ALLOWED:
        allowed = allowed | text.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(text, window) >= least)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: row, doc_id, found (array of start, rank, stop, kind; sorted; stop exclusive)."""
    text = F.col("body")
    found = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id"), text_or_empty(F.col("text")).alias("body")
    ).select(
        "row",
        "doc_id",
        _found(text, ASSIGN, 2).alias("assign"),
        _found(text, ACCESS).alias("access"),
        _found(text, HEX).alias("hex"),
        _found(text, RUN).alias("entropy"),
    )
    empty = F.expr("cast(array() as array<struct<gap:int,size:int,part:int,found:string,rank:int,at:int>>)")
    each = [F.coalesce(_ranked(F.col(kind), rank), empty) for rank, kind in enumerate(KINDS)]
    rows = found.select("row", "doc_id", F.explode_outer(F.concat(*each)).alias("m")).select(
        "row",
        "doc_id",
        "m.gap",
        "m.size",
        "m.rank",
        "m.at",
        F.when(F.col("m.rank") == 0, F.col("m.part") >= ASSIGN_LEAST)
        .when(F.col("m.rank") == 3, is_random(F.col("m.found")))
        .otherwise(F.col("m.rank").isNotNull())
        .alias("good"),
    )
    before = "PARTITION BY row, rank ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    rows = rows.repartition("row").withColumn("stop", F.expr(f"sum(gap + size) OVER ({before})").cast("long"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1)
    span = F.struct((F.col("stop") - F.col("size")).alias("start"), "rank", "stop", kind.alias("kind"))
    return rows.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.when(F.col("good"), span))).alias("found")
    )


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
