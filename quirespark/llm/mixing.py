"""Mixing sources to target weights by subset-sum budget fitting.

Every source has a target number of words. Whole passes over the source are taken first; what is left of the target is
a budget smaller than the source. The source's documents are counted by exact length; each length gives its share of
the budget, rounded down, and what that leaves is filled with unused documents, the longest first. A bounded-knapsack
dynamic programme over added and given-back documents then closes the gap. The documents of a length are chosen by
seeded order.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bucketed_rank, words

#: Words on either side of the filled sum that the dynamic programme looks at first, and at most.
KNAPSACK, WIDEST = 1 << 16, 1 << 24
#: Table entries that the programme may visit for one source before it settles for the nearest sum seen.
VISITS = 10**10


def fit_budget(lengths: list[int], counts: list[int], budget: int, knapsack: int = KNAPSACK, *, widest: int = WIDEST, visits: int = VISITS) -> list[int]:
    """How many documents of each length to take, so that their words are the largest sum that is not above budget.

    lengths are distinct and positive, 0 <= budget. The fill alone ends less than the shortest unused document below the
    budget. The knapsack looks at sums within `room` of it, and room doubles from `knapsack` until the budget is met or
    no wider room can matter: of a nearest choice with the fewest changes no part of the changes sums to zero, so that,
    put in an order that keeps every sum within the longest length of the start, they are at most twice as many as that
    length has words. The result is the nearest sum, unless `widest` words or `visits` entries end the search before;
    then it is the nearest seen, at least as near as the fill.
    """
    unit = math.gcd(*lengths) if lengths else 1
    sizes = [x // unit for x in lengths]
    goal, total = budget // unit, sum(x * c for x, c in zip(sizes, counts, strict=True))
    if total <= goal:
        return list(counts)
    take = [c * goal // total for c in counts]
    gap = goal - sum(x * t for x, t in zip(sizes, take, strict=True))
    order = sorted(range(len(sizes)), key=lambda i: sizes[i])
    for i in reversed(order):
        more = min(counts[i] - take[i], gap // sizes[i])
        take[i], gap = take[i] + more, gap - more * sizes[i]
    room = knapsack
    while gap:
        taken = goal - gap
        useful = min(max(sizes) * (max(sizes) + 1), taken, total - taken)
        room = min(room, useful, widest)
        changes, reached, visited = _nearest(sizes, counts, take, order, min(room, taken), min(room + gap, total - taken), gap, visits)
        for i, b in changes:
            take[i] += b
        gap, visits = gap - reached, visits - visited
        if room >= min(useful, widest) or visits <= 0:
            break
        room *= 2
    return take


def _nearest(sizes: list[int], counts: list[int], take: list[int], order: list[int], down: int, up: int, gap: int, visits: int) -> tuple[list[tuple[int, int]], int, int]:
    """The changes to `take` that come nearest to `gap` from below, with sums from -down to up; (changes, sum, entries visited)."""
    first = np.full(down + up + 1, -1, np.int32)  # the bundle that first reached a sum; each is used once at most
    first[down], bundles, visited = 0, [(0, 0)], 0
    goal = down + gap
    for i, sign in ((i, sign) for i in order for sign in (1, -1)):
        left, bundle = min(counts[i] - take[i] if sign > 0 else take[i], (down + up) // sizes[i]), 1
        while left > 0 and first[goal] < 0 and visited < visits:
            b = min(bundle, left)
            w = b * sizes[i]
            low, high = first[:-w], first[w:]
            new = np.flatnonzero((low >= 0) & (high < 0)) + w if sign > 0 else np.flatnonzero((high >= 0) & (low < 0))
            first[new] = len(bundles)
            bundles.append((i, sign * b))
            left, bundle, visited = left - b, bundle * 2, visited + len(first)
    at = int(np.flatnonzero(first[: goal + 1] >= 0)[-1])
    reached, changes = at - down, []
    while at != down:
        i, b = bundles[first[at]]
        changes.append((i, b))
        at -= b * sizes[i]
    return changes, reached, visited


def source_targets(sizes: DataFrame, ws: Workspace, *, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, share: float = 1.0) -> DataFrame:
    """(source, source_size) -> adds source_rank, weight and target.

    Sources by code point, null last, get the weights in turn, repeating. Targets divide `share` of all words by weight;
    a target stops at `most` times its source's size, and the excess is divided among the others by weight until none is
    above. Sources without words get the target 0. Only sums come to the driver.
    """
    # code point order is the order of UTF-8 bytes; null is its own key, last
    ranked = bucketed_rank(sizes.withColumn("k_", F.lit(0)), ["k_"], [F.col("source").asc_nulls_last()], F.coalesce(F.substring(F.hex("source"), 1, 4), F.lit("~")), "source_rank").drop("k_")
    weight = F.element_at(F.lit([float(w) for w in weights]), (F.pmod(F.col("source_rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = ws.write(ranked.withColumn("weight", weight), "sources")
    all_words = float(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    roof = F.col("source_size") * F.lit(most)
    level = None
    while True:
        capped = F.lit(False) if level is None else roof <= F.col("weight") * level
        taken, free, n = ranked.agg(F.coalesce(F.sum(F.when(capped, roof)), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)), F.count(F.when(capped, 1))).first()
        new = max(0.0, all_words - taken) / free if free else float("inf")
        if level is not None and (n == old or not free):
            break
        level, old = new, n
    return ranked.withColumn("target", F.when(capped, roof).otherwise(F.col("weight") * F.lit(level)) if free else roof)


def mix(docs: DataFrame, *, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 17) -> DataFrame:
    """Adds size, source_size, target, taken to docs; taken is the words that the mix takes of a row, repeats counted.

    A null or blank text has size 0 and taken 0. A null source is a source of its own, last in order. The choice is
    decided by seed, doc_id and text, so that reruns agree whatever the partitions; of rows that repeat both, as many as
    the fit asks for are taken, whichever they are. Clashing column names of docs (size, source_size, target, taken) are
    replaced. An empty table gives an empty result.
    """
    d = _decided(docs, text_col, source_col, id_col, weights, most, seed)
    keep = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")]
    return d.select(*[F.col("row_")[c].alias(c) for c in keep], F.col("size_").alias("size"), "source_size", "target", (F.col("size_") * F.col("times_")).alias("taken"))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with docs' columns. Rows without words are not taken."""
    defaults = {"text_col": "text", "source_col": "source", "id_col": "doc_id", "weights": (1, 2, 3), "most": 3.0, "seed": 17} | parameters
    d = _decided(docs, *[defaults[k] for k in ("text_col", "source_col", "id_col", "weights", "most", "seed")])
    times = F.when(F.col("size_") > 0, F.col("times_")).otherwise(F.lit(0).cast("long"))
    d = d.where(times > 0).withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    return d.select(*[F.col("row_")[c].alias(c) for c in docs.columns])


def _decided(docs: DataFrame, text_col: str, source_col: str, id_col: str, weights: tuple[float, ...], most: float, seed: int) -> DataFrame:
    """Rows as row_ with size_, source_size, target and times_ (how often each is taken)."""
    spark = docs.sparkSession
    ws = Workspace(spark, "mixing")
    text, source = F.col(text_col).cast("string"), F.col(source_col).cast("string")
    d = docs.select(F.struct("*").alias("row_"), source.alias("source_"), F.size(words(text)).cast("long").alias("size_"), F.xxhash64(F.lit(seed), F.col(id_col), text).alias("order_"))
    slim = ws.write(d.select("source_", "size_", "order_"), "sizes")
    by_length = ws.write(slim.groupBy("source_", "size_").agg(F.count(F.lit(1)).alias("n")), "lengths")
    sizes = by_length.groupBy(F.col("source_").alias("source")).agg(F.sum(F.col("size_") * F.col("n")).alias("source_size"))
    targets = ws.write(source_targets(sizes, ws, weights=weights, most=most), "targets")

    def fit(key, pdf):
        goal, size = int(round(pdf["target"].iloc[0])), int(pdf["source_size"].iloc[0])
        passes = goal // size if size else 0
        lengths, counts = pdf["size_"].tolist(), pdf["n"].tolist()
        some = [i for i, x in enumerate(lengths) if x > 0]
        take = [0] * len(lengths)
        if some:
            for i, t in zip(some, fit_budget([lengths[i] for i in some], [counts[i] for i in some], goal - passes * size), strict=True):
                take[i] = t
        return pdf.assign(passes=passes, take=take)[["source_", "size_", "n", "source_size", "target", "passes", "take"]]

    joined = by_length.join(targets, F.col("source_").eqNullSafe(F.col("source")))
    # a group has a row for each distinct length of a source, however many documents that has
    plan = ws.write(joined.groupBy("source_rank").applyInPandas(fit, "source_ string, size_ long, n long, source_size long, target double, passes long, take long"), "plan")
    part = plan.where("take > 0 and take < n").select(F.col("source_").alias("s_"), F.col("size_").alias("z_"), "take")
    both = F.col("source_").eqNullSafe(F.col("s_")) & (F.col("size_") == F.col("z_"))
    ranked = bucketed_rank(slim.join(part, both).select("source_", "size_", "order_", "take"), ["source_", "size_"], [F.col("order_").asc()], F.shiftright("order_", 56), "rank_")
    # the last order that is taken, with the number of rows that have it (ties_) and of those that are taken (some_)
    orders = ranked.groupBy("source_", "size_", "take", "order_").agg(F.min("rank_").alias("before_"), F.count(F.lit(1)).alias("ties_")).where("before_ < take and take <= before_ + ties_")
    last = orders.select(F.col("source_").alias("s_"), F.col("size_").alias("z_"), F.col("order_").alias("last_"), "ties_", (F.col("take") - F.col("before_")).alias("some_"))
    plan = ws.write(plan.join(last, both, "left").select(F.col("source_").alias("s_"), F.col("size_").alias("z_"), "source_size", "target", "passes", "n", "take", "last_", "ties_", "some_"), "choice")
    d = d.join(plan, both)
    split = (F.col("order_") == F.col("last_")) & (F.col("some_") < F.col("ties_"))
    out = ["row_", "size_", "source_size", "target"]

    def taken(chosen):
        return [*out, (F.col("passes") + F.when(chosen, 1).otherwise(0)).alias("times_")]

    whole = d.where(~F.coalesce(split, F.lit(False))).select(*taken((F.col("take") >= F.col("n")) | (F.col("order_") <= F.col("last_"))))
    if plan.where("some_ < ties_").isEmpty():
        return whole
    # rows that repeat id and text and of which only some are taken: numbered by their places in a stored table
    tied = ws.write(d.where(split).withColumn("at_", F.monotonically_increasing_id()), "tied")
    numbered = bucketed_rank(tied.select("source_", "at_", *out, "passes", "some_"), ["source_", "size_"], [F.col("at_").asc()], F.shiftright("at_", 33), "rank_")
    return whole.union(numbered.select(*taken(F.col("rank_") < F.col("some_"))))
