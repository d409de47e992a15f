"""Connected components of a table of edges, by alternating large and small stars until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.shared import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (larger ones, or else all that aren't larger and itself) move to the least of them.

    The least is an aggregate with partial sums, so that a node with very many neighbours is no single task.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = both.filter("v < u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return moved.filter("u != v").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(u, v): every node of ``edges`` (long u, long v) that isn't the least of its component, with that least node."""
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    last = None
    for _ in range(rounds):
        if edges.isEmpty():
            return edges
        edges = cut(_star(_star(edges, True), False))
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return edges
        last = state
    raise RuntimeError(f"no end after {rounds} rounds")
