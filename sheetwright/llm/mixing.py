"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are grouped by the set of sources they belong to (their pattern). Token
capacity flows from the patterns to the quotas of their sources; repeating a
pattern's documents costs more each time (0 for the first copy, then 1, 4, ...),
so nothing repeats while unused text is left. A pattern's flow is then met with
whole documents in seeded order.

Sources, their ranks, targets and quotas are tables. Patterns that no chain of common sources
links have networks of their own, each solved in a task; a source that no pattern shares
is such a network, so the number of sources is free. A network of more than MAX_PATTERNS
linked patterns is refused with an error.

Edge cases: a null text has size 0; a null source is a source of its own that
sorts last; an empty table gives an empty mix; repeated rows are documents of
their own; documents without an id are put in order by their text; other columns are carried
inside ``doc`` and so can't clash.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words
from .simhash import components

MAX_PATTERNS = 50_000


def capped_targets(sizes: list[int], weights: list[int], budget: float, cap: int = 2) -> list[float]:
    """Share budget by weight; no share above cap times its size, the excess going to the others by weight."""
    order = sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i))
    targets, left, weight = [0.0] * len(sizes), float(budget), sum(weights)
    for n, i in enumerate(order):
        if left / weight * weights[i] <= cap * sizes[i]:
            for j in order[n:]:
                targets[j] = left / weight * weights[j]
            break
        targets[i] = float(cap * sizes[i])
        left, weight = left - cap * sizes[i], weight - weights[i]
    return targets


def min_cost_flow(patterns: list[tuple[frozenset, int]], quotas: dict, copies: int) -> list[int]:
    """Tokens each pattern (its sources, its tokens) sends to the quotas, cheapest first.

    Copies of one cost form a layer; layers are filled in order of cost, each by
    augmenting paths (pattern, source, pattern, ...) that may reroute what earlier
    layers sent. Costs sit on the patterns alone, so a cheapest augmentation is any
    path from the cheapest copy that is left.
    """
    left, sent = dict(quotas), [dict.fromkeys(p, 0) for p, _ in patterns]
    holders: dict = {}
    for i, (p, _) in enumerate(patterns):
        for s in p:
            holders.setdefault(s, []).append(i)
    for _ in range(copies):
        for i, (p, tokens) in enumerate(patterns):
            room = tokens
            while room > 0:
                came, reach, end = {("p", i): None}, [("p", i)], None
                for kind, x in reach:
                    if kind == "s" and left.get(x, 0) > 0:
                        end = ("s", x)
                        break
                    if kind == "p":
                        nexts = [("s", s) for s in sorted(patterns[x][0], key=repr)]
                    else:
                        nexts = [("p", k) for k in holders[x] if sent[k][x] > 0]
                    for y in nexts:
                        if y not in came:
                            came[y] = (kind, x)
                            reach.append(y)
                if end is None:
                    break
                path, at = [], end
                while at is not None:
                    path.append(at)
                    at = came[at]
                path.reverse()
                back = [sent[path[k + 1][1]][path[k][1]] for k in range(1, len(path) - 1, 2)]
                amount = min([room, left[end[1]], *back])
                for k in range(len(path) - 1):
                    (kind, x), (_, y) = path[k], path[k + 1]
                    if kind == "p":
                        sent[x][y] += amount
                    else:
                        sent[y][x] -= amount
                left[end[1]] -= amount
                room -= amount
    return [sum(x.values()) for x in sent]


def ranked(sources: DataFrame) -> DataFrame:
    """Sources (source, s) with rank, 0 to n-1 by code point, null last: range partitions and their offsets."""
    order = [F.col("source").isNull(), F.col("source")]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = sources.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(rows.select("source", "s", F.spark_partition_id().alias("part"), place.alias("nth")), "mix-ranked")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    return rows.join(offsets, "part").select("source", "s", (F.col("ahead") + F.col("nth")).alias("rank"))


def with_targets(sources: DataFrame, weights: tuple[int, ...], budget: float, cap: int) -> DataFrame:
    """Sources (source, s, rank), written, with target as capped_targets has it: each round stops the sources that are above their cap."""
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = cut(sources.withColumn("w", w), "mix-sources")
    share, stopped = 0.0, -1
    while True:
        full = F.lit(share) * F.col("w") > cap * F.col("s")
        r = sources.agg(
            F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, F.col("s")).otherwise(0)).alias("s"), F.sum(F.when(~full, F.col("w")).otherwise(0)).alias("w")
        ).first()
        if r["n"] == stopped or not r["w"]:
            break
        stopped = r["n"]
        share = (budget - float(cap * r["s"])) / float(r["w"])
    full = F.lit(share) * F.col("w") > cap * F.col("s")
    return sources.withColumn("target", F.when(full, F.lit(float(cap)) * F.col("s")).otherwise(F.lit(share) * F.col("w")))


def _flows(patterns: DataFrame, copies: int, most: int) -> DataFrame:
    """(p, flow) of patterns (p, tokens, ranks, quotas), each network of linked patterns solved in a group of its own."""
    first = F.col("ranks")[0]
    links = patterns.filter(F.size("ranks") > 1).select(first.alias("a"), F.explode("ranks").alias("b")).filter("a <> b").distinct()
    if links.isEmpty():
        patterns = patterns.withColumn("net", first)
    else:
        roots = cut(components(links), "mix-networks")
        patterns = patterns.withColumn("first", first).join(roots, F.col("first") == F.col("v"), "left").withColumn("net", F.coalesce("root", "first"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > most:
            raise ValueError(f"more than {most} patterns in one network of sources")
        rows = rows.assign(key=[tuple(r) for r in rows["ranks"]]).sort_values("key")
        quotas = {s: int(q) for r, t in zip(rows["ranks"], rows["quotas"], strict=True) for s, q in zip(r, t, strict=True)}
        flow = min_cost_flow([(frozenset(k), int(t)) for k, t in zip(rows["key"], rows["tokens"], strict=True)], quotas, copies)
        return pd.DataFrame({"p": rows["p"], "flow": flow})

    return patterns.filter("net IS NOT NULL").groupBy("net").applyInPandas(lambda rows: solve(rows), "p string, flow long")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    budget_share: float = 1.5,
    copies: int = 2,
    seed: int = 42,
    sources: str | None = None,
    size: str | None = None,
    most: int = MAX_PATTERNS,
) -> DataFrame:
    """One row a document: doc (all its columns), size, source_size, target, n_copies, taken.

    sources: a column with an array of the sources a document belongs to; without it
    each document belongs to its ``source``. A document of several sources counts in
    the size of each; source_size and target are sums over a document's sources. size:
    a column with the sizes, in place of the number of words of ``text``.
    """
    member = F.array_sort(F.array_distinct(F.coalesce(F.col(sources), F.array()))) if sources else F.array(F.col("source").cast("string"))
    # what tells documents of one id, or of none, apart: the text or, where docs has none, the other columns
    tie = F.xxhash64("text") if "text" in docs.columns else F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")))
    rows = docs.select(
        F.struct("*").alias("doc"),
        (F.col(size) if size else n_words(F.col("text").cast("string"))).alias("size"),
        member.alias("pattern"),
        tie.alias("tie"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), tie)))).alias("h"),
    )
    rows = rows.withColumn("p", _key(F.col("pattern"))).withColumn("slice", F.substring("h", 1, 3))
    sums = rows.groupBy("p", "slice").agg(F.first("pattern").alias("pattern"), F.sum("size").alias("slice_size"))
    return _mix(rows, cut(sums, "mix-slices"), weights, budget_share, copies, most)


def _key(pattern: Column) -> Column:
    """The pattern as text, in which null members compare equal."""
    return F.to_json(F.transform(pattern, lambda s: F.struct(s.alias("s"))))


def _mix(rows: DataFrame, sums: DataFrame, weights, budget_share, copies, most) -> DataFrame:
    patterns = cut(sums.groupBy("p").agg(F.first("pattern").alias("pattern"), F.sum("slice_size").alias("tokens")), "mix-patterns")
    budget = budget_share * (patterns.agg(F.sum("tokens")).first()[0] or 0)
    member = patterns.select("p", "tokens", F.explode("pattern").alias("source"))
    own = cut(member.groupBy("source").agg(F.sum("tokens").alias("s")), "mix-own")
    own = cut(with_targets(ranked(own), weights, budget, copies), "mix-targets")
    member = member.join(own, member["source"].eqNullSafe(own["source"])).select("p", "tokens", "s", "rank", "target")
    pair = F.sort_array(F.collect_list(F.struct("rank", F.floor(F.col("target") + 0.5).cast("long").alias("quota"))))
    plan = member.groupBy("p").agg(
        F.first("tokens").alias("tokens"), F.sum("s").alias("source_size"), F.sum("target").alias("target"),
        F.transform(pair, lambda x: x["rank"]).alias("ranks"), F.transform(pair, lambda x: x["quota"]).alias("quotas"),
    )
    plan = cut(plan, "mix-plan")
    flows = _flows(plan.select("p", "tokens", "ranks", "quotas"), copies, most)
    full, rest = F.expr("if(tokens > 0, flow div tokens, 0)"), F.expr("if(tokens > 0, flow % tokens, 0)")
    plan = plan.join(flows, "p").select("p", "source_size", "target", full.alias("full"), rest.alias("rest"))
    # A pattern without sources takes part in no flow.
    nothing = patterns.filter(F.coalesce(F.size("pattern"), F.lit(0)) <= 0).select(
        "p", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("full"), F.lit(0).cast("long").alias("rest")
    )
    plan = cut(plan.unionByName(nothing), "mix-flows")
    # A prefix sum in two steps, as a pattern may hold a third of all rows: over its 4096 slices, then in each slice.
    over = "PARTITION BY p ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    slices = sums.select("p", "slice", F.coalesce(F.expr(f"sum(slice_size) OVER ({over})"), F.lit(0)).alias("ahead"))
    over = "PARTITION BY p, slice ORDER BY h, doc.doc_id, size, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    rows = rows.withColumn("before", F.coalesce(F.expr(f"sum(size) OVER ({over})"), F.lit(0)))
    rows = rows.join(slices, ["p", "slice"]).join(plan, "p")
    extra = (2 * (F.col("ahead") + F.col("before")) + F.col("size") <= 2 * F.col("rest")) & (F.col("rest") > 0)
    n = F.col("full") + extra.cast("long")
    return rows.select("doc", "size", "source_size", "target", n.alias("n_copies"), (n * F.col("size")).alias("taken"))
