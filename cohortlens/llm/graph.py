"""Connected components as DataFrame joins: distributed union-find by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root`` (the smallest node of the component) for every node of an edge
    table of longs. Loops and null ends are left out; repeated edges count once.

    Each round points every node at its smallest neighbour, follows the pointers once,
    and contracts the edges to the pointed-at nodes. The first round orders nodes by id,
    so that stars around the smallest node vanish at once, later ones by a hash of id
    and round, so that chains shrink by a constant factor. Minima are combined before
    the shuffle and joins read written tables: a node with many edges is split."""
    ends = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    left = settle(ends.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, turn = None, 0
    while not left.isEmpty():
        rank = (lambda c: F.col(c)) if turn == 0 else (lambda c, t=turn: F.xxhash64(F.lit(t), c))
        both = left.union(left.select("b", "a")).select("a", F.struct(rank("b").alias("k"), F.col("b").alias("to")).alias("x"))
        near = both.groupBy("a").agg(F.min("x").alias("x"))
        own = F.struct(rank("a").alias("k"), F.col("a").alias("to"))
        up = settle(near.select(F.col("a").alias("node"), F.least("x", own)["to"].alias("up")))
        # Smaller ranks point nowhere larger, so pointers have no cycles.
        again = up.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        jump = settle(up.join(again, "up", "left").select("node", F.coalesce("up2", "up").alias("up")))
        at_a = jump.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        at_b = jump.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = left.join(at_a, "a").join(at_b, "b").where("ua != ub")
        left = settle(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
        if labels is None:
            labels = jump
        else:
            step = jump.select(F.col("node").alias("up"), F.col("up").alias("next"))
            labels = settle(labels.join(step, "up", "left").select("node", F.coalesce("next", "up").alias("up")))
        turn += 1
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    least = settle(labels.groupBy("up").agg(F.min("node").alias("root")))
    return labels.join(least, "up").select("node", "root")
