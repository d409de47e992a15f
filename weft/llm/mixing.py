"""Mixing sources to target weights by subset-sum fitting of word budgets.

1. Sizes are summed by source; targets are shares of the budget by weight, none above ``most_copies`` times its
   source's size, the excess going to the others by weight.  One row a source reaches the driver.
2. For each source, on the counts of documents by exact size (one row a distinct size): whole copies, then the same
   share of every size, then larger sizes while they fit, then a bounded-knapsack DP for the rest of the budget.
3. The documents of a size that are taken once more are the first by a seeded hash.  Ranks are counted by slice of that
   hash, so that a size that very many documents have is dealt over many tasks.

Defined results.  A null text has size 0, and nothing is ever taken of it.  A null source is a source of its own, last
in order.  Rows with equal doc_id and size in a source are interchangeable.  An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.shared import cut

WORD = r"[^\x20\x09-\x0D]+"
SLICES = 512
#: The DP's budget in words at most.  What the equal shares leave above it goes to whole documents first, the largest that
#: fit, so that the DP decides on the last words; it is exact for these.  What a source's words then miss below its target
#: is less than the smallest document that is left, unless all fit.
DP_BUDGET = 1 << 15


def targets(sizes: list[int], weights: list[float], budget: float, most_copies: int) -> list[float]:
    """Shares of the budget by weight, capped, the excess reshared by weight until none is above its cap."""
    out, free = [0.0] * len(sizes), {k for k in range(len(sizes)) if sizes[k]}
    while free:
        total = sum(weights[k] for k in free)
        over = {k for k in free if budget * weights[k] / total > most_copies * sizes[k]}
        for k in over or free:
            out[k] = float(most_copies * sizes[k]) if over else budget * weights[k] / total
        budget -= sum(out[k] for k in over)
        free = free - over if over else set()
    return out


def fit(size: np.ndarray, count: np.ndarray, budget: float) -> np.ndarray:
    """How many of each size to take, at most ``count``, so that the words come as near to ``budget`` as found.

    What comes nearest from above leaves out what comes nearest from below to the rest.
    """
    size, count = size.astype(np.int64), count.astype(np.int64)
    total = int((size * count).sum())
    goal = min(int(budget + 0.5), total)
    if not total:
        return np.zeros_like(count)
    below = _fit_below(size, count, goal, total)
    if (size * below).sum() == goal:
        return below
    above = count - _fit_below(size, count, total - goal, total)
    return min(below, above, key=lambda x: abs(int((size * x).sum()) - budget))


def _fit_below(size: np.ndarray, count: np.ndarray, goal: int, total: int) -> np.ndarray:
    taken = np.minimum(count * goal // total, count)
    left, spare = goal - int((size * taken).sum()), count - taken
    order = np.argsort(-size, kind="stable").tolist()
    moved = True
    while left > DP_BUDGET and moved:  # rounds of one document of each size, the largest first
        moved = False
        for k in order:
            if left <= DP_BUDGET:
                break
            if spare[k] and 0 < size[k] <= left:
                taken[k], spare[k], left, moved = taken[k] + 1, spare[k] - 1, left - int(size[k]), True
    return taken + knapsack(size, spare, left)


def knapsack(size: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: how many of each size, for the largest sum that is at most ``budget``. Sums are bits of an int."""
    taken = np.zeros(len(size), dtype=np.int64)
    budget = max(0, int(budget))
    reach, mask, steps = 1, (1 << (budget + 1)) - 1, []
    for k in np.argsort(-size, kind="stable").tolist():
        x = int(size[k])
        rest = min(int(count[k]), budget // x) if x else 0
        times = 1
        while rest and not reach >> budget & 1:
            times = min(times, rest)
            after = reach | (reach << (x * times)) & mask
            if after != reach:
                steps.append((k, x, times, reach))
                reach = after
            rest -= times
            times *= 2
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    for k, x, times, before in reversed(steps):
        if not before >> at & 1:
            taken[k] += times
            at -= x * times
    return taken


def mix(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most_copies: int = 2, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    rows = documents.select(F.col("doc_id").cast("long"), F.struct(F.col("source").cast("string").alias("name")).alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return _mix(rows, weights, budget, most_copies, seed, ()).select("doc_id", "size", "source_size", "target", "taken")


def resample(documents: DataFrame, **how) -> DataFrame:
    """The documents as the mix takes them: each row as often as it is taken. Columns and their order stay."""
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    rows = documents.select(F.col("doc_id").cast("long"), F.struct(F.col("source").cast("string").alias("name")).alias("source"), size, row)
    settings = {"weights": (5, 2, 1), "budget": 1.5, "most_copies": 2, "seed": 17} | how
    mixed = _mix(rows, **settings, keep=("row",)).filter(F.col("taken") > 0)
    copies = F.explode(F.array_repeat(F.lit(0), (F.col("taken") / F.col("size")).cast("int")))
    return mixed.select("row", copies.alias("copy")).select("row.*")


def _mix(rows: DataFrame, weights, budget, most_copies, seed, keep) -> DataFrame:
    spark = rows.sparkSession
    order = F.xxhash64(F.lit(seed), "doc_id")
    counted = cut(rows.drop(*keep).groupBy("source", "size", F.pmod(order, F.lit(SLICES)).cast("int").alias("slice")).agg(F.count(F.lit(1)).alias("n")))
    by_size = counted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("total")).collect()
    names = sorted(sources, key=lambda r: (r.source.name is None, (r.source.name or "").encode("utf-8", "surrogatepass")))
    totals = [int(r.total) for r in names]
    goals = targets(totals, [weights[k % len(weights)] for k in range(len(names))], budget * sum(totals), most_copies)
    goal = spark.createDataFrame(
        [((r.source.name,), t, g) for r, t, g in zip(names, totals, goals, strict=True)], "source struct<name:string>, source_size long, target double"
    )

    def chosen(part: pd.DataFrame) -> pd.DataFrame:
        total, target = int(part.source_size.iloc[0]), float(part.target.iloc[0])
        whole = min(int(target // total), most_copies) if total else 0
        part = part.sort_values("size")
        part["extra"] = fit(part["size"].to_numpy(), part["n"].to_numpy(), target - whole * total) if whole < most_copies else 0
        part["whole"] = whole
        part["name"] = part["name"].where(part["named"], None)
        return part[["name", "size", "source_size", "target", "whole", "extra"]]

    # Struct keys compare nulls as equal, so that a null source needs no care in the joins.
    flat = by_size.join(goal, "source").select(F.coalesce("source.name", F.lit("")).alias("name"), F.col("source.name").isNotNull().alias("named"), "size", "n", "source_size", "target")
    fitted = flat.groupBy("name", "named").applyInPandas(chosen, "name string, size long, source_size long, target double, whole long, extra long")
    fitted = cut(fitted.select(F.struct("name").alias("source"), "size", "source_size", "target", "whole", "extra"))
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("slice")) - F.col("n")
    slices = counted.withColumn("before", before).join(fitted, ["source", "size"])
    # A slice is taken wholly, not at all, or (one slice a size) up to a rank within it.
    slices = slices.select("source", "size", "slice", "source_size", "target", "whole", (F.col("extra") - F.col("before")).alias("room"), "n")
    dealt = rows.withColumn("order", order).withColumn("slice", F.pmod("order", F.lit(SLICES)).cast("int")).join(slices, ["source", "size", "slice"])
    rank = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("order", "doc_id"))
    more = (rank <= F.col("room")).cast("long")
    return dealt.withColumn("taken", (F.col("whole") + more) * F.col("size"))

