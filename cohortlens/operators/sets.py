"""Sorts with limits and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import join_on


def priority_queue(rows: DataFrame, weights: Mapping[str, float], order: Sequence[Column], budget: int) -> DataFrame:
    """Weighted priority, best first, within the budget (a top-n report)."""
    terms = [F.lit(w) * F.col(x).cast("double") for x, w in weights.items()]
    return rows.withColumn("priority", sum(terms[1:], terms[0])).orderBy(F.col("priority").desc(), *order).limit(budget)


def top_values(rows: DataFrame, value: str, n: int) -> DataFrame:
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(value)).limit(n)


def nearest_to_mean_row(rows: DataFrame, key: str, weights: Mapping[str, float]) -> DataFrame:
    """The row with the least weighted L1 distance to the column means."""
    means = rows.agg(*[F.avg(x).alias(f"__m_{x}") for x in weights])
    joined = join_on(rows, means, [])
    terms = [F.lit(w) * F.abs(F.col(x) - F.col(f"__m_{x}")) for x, w in weights.items()]
    d = F.round(sum(terms[1:], terms[0]), 9)
    best = F.min(F.struct(d.alias("distance"), F.col(key).alias(key), *[F.col(x) for x in weights])).alias("b")
    return joined.agg(best).select("b.*")


def tagged_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids of both sets tagged both / a_only / b_only."""
    left = a.select(key).distinct().withColumn("__a", F.lit(1))
    right = b.select(key).distinct().withColumn("__b", F.lit(1))
    out = left.join(right, key, "full_outer")
    tag = F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), "both").when(F.col("__a").isNotNull(), "a_only").otherwise("b_only")
    return out.select(key, tag.alias("tag"))


def two_side_rows(units: DataFrame, carry: Sequence[str]) -> DataFrame:
    """One row per (unit, side) with the roles swapped; one scan."""
    home = F.struct(
        F.lit("home").alias("venue"), F.col("home").alias("side"), F.col("away").alias("opponent"),
        F.col("home_goals").alias("goals_for"), F.col("away_goals").alias("goals_against"),
    )
    away = F.struct(
        F.lit("away").alias("venue"), F.col("away").alias("side"), F.col("home").alias("opponent"),
        F.col("away_goals").alias("goals_for"), F.col("home_goals").alias("goals_against"),
    )
    return units.select(*carry, F.inline(F.array(home, away)))


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return tagged_union(a, b, key).where(F.col("tag") != "both")


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def frame_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one frame and not in the other with multiplicity; empty means equal."""
    cols = a.columns
    return (
        a.select(*cols).exceptAll(b.select(*cols)).withColumn("only_in", F.lit("a"))
        .unionByName(b.select(*cols).exceptAll(a.select(*cols)).withColumn("only_in", F.lit("b")))
    )
