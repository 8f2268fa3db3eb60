"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, discard
from .ordered import join_on


def components(edges: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """``keys``, ``node``, ``root``: for every node of a group's edges the smallest node
    that it can reach. Edges with a null end only make their other end a node.

    Each round takes the smallest root among a node and its neighbours, then follows roots
    twice, so distances shrink by a factor; it ends when no root has changed. Minima are
    combined before the shuffle, and each round's table replaces the one before."""
    keys = list(keys)
    ends = F.inline(F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("to")), F.struct(F.col(b).alias("node"), F.col(a).alias("to"))))
    both = cut_lineage(edges.select(*keys, ends).where(F.col("node").isNotNull()).distinct())
    roots = cut_lineage(both.select(*keys, "node").distinct().withColumn("root", F.col("node")))
    while True:
        at = lambda n, out: roots.select(*keys, F.col("node").alias(n), F.col("root").alias(out))  # noqa: B023, E731
        near = join_on(both, at("to", "__r"), [*keys, "to"], nulls=True).groupBy(*keys, "node").agg(F.min("__r").alias("__near"))
        met = join_on(roots, near, [*keys, "node"], "left", nulls=True).select(*keys, "node", F.col("root").alias("__old"), F.least("root", "__near").alias("__r1"))
        for n in (1, 2):
            met = join_on(met, at(f"__r{n}", f"__r{n + 1}"), [*keys, f"__r{n}"], nulls=True)
        after = cut_lineage(met.select(*keys, "node", F.least("__r1", "__r2", "__r3").alias("root"), "__old"))
        discard(roots)
        roots = after.drop("__old")
        if after.where(F.col("root") != F.col("__old")).isEmpty():
            discard(both)
            return roots
