"""From entity features to cohort ranks, centroids, best members and line-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip, per_exposure, safe_ratio, weighted_composite
from ..operators import ordered
from ..operators.ordered import join_on
from ..operators.resample import bootstrap_ci
from ..operators.windows import (
    ecdf_position,
    latest_by_key,
    robust_unit,
    shrink_to_cohort,
    top_n_per_group,
    winsorised_z,
)
from ..session import cut_lineage


def rank_cohort(
    features: DataFrame,
    metrics: DataFrame,
    cohort: str = "cohort",
    entity: str = "entity",
    exposure: str = "minutes",
    minimum: float = 180.0,
    prior: float = 180.0,
) -> DataFrame:
    """Eligible entities scored inside their cohort: metrics shrunk to the cohort mean,
    winsorised z times direction, mean over the cohort's metrics, competition rank.

    ``metrics`` has (cohort, metric, direction). The metrics run as long rows keyed by
    (cohort, metric, entity), so the statistics group by (cohort, metric)."""
    # Everything below reads the entity table several times; it is far smaller than the
    # rows it was aggregated from, so it is written once.
    eligible = cut_lineage(features.where(F.col(exposure) >= minimum))
    keys = [cohort, "metric"]
    long = long_metrics(eligible, metrics, [entity, cohort, exposure], cohort)
    adjusted = shrink_to_cohort(long, keys, "value", exposure, prior, "adjusted")
    # What follows reads the long rows and the scores several times over.
    z = winsorised_z(cut_lineage(adjusted), keys, "adjusted", "z")
    scores = z.groupBy(entity, cohort).agg(F.round(F.avg(F.col("z") * F.col("direction")), 9).alias("rank_score"))
    scored = cut_lineage(eligible.join(scores, [entity, cohort]))
    out = ordered.competition_rank(scored, [cohort], "rank_score", "position_rank")
    return out.withColumn("reliability", F.col(exposure) / (F.col(exposure) + F.lit(prior)))


def top_members(ranked: DataFrame, n: int, cohort: str = "cohort", entity: str = "entity") -> DataFrame:
    return top_n_per_group(ranked, [cohort], [F.col("rank_score").desc(), F.col(entity)], n)


def long_metrics(rows: DataFrame, metrics: DataFrame, keep: Sequence[str], cohort: str = "cohort") -> DataFrame:
    """(cohort, metric) rows of a wide frame; ``metrics`` decides which are kept. Columns
    the frame lacks count as 0."""
    names = {r["metric"] for r in metrics.select("metric").collect()}  # the metric list, not data
    present = [n for n in sorted(names) if n in rows.columns]
    return (
        rows.select(*keep, *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in present])
        .unpivot(list(keep), present, "metric", "value")
        .join(metrics, [cohort, "metric"])
    )


def build_centroids(
    ranked: DataFrame,
    metrics: DataFrame,
    n: int = 20,
    fraction: float = 0.10,
    seed: int | None = None,
    resamples: int = 2000,
    cohort: str = "cohort",
    entity: str = "entity",
) -> tuple[DataFrame, DataFrame]:
    """Robust centroid of the top ``n`` of each cohort: per metric trimmed mean, mean,
    median, sd (n-1), optional bootstrap interval, and the centroid's percentile in the
    whole pool; plus one summary row per cohort."""
    ranked = cut_lineage(ranked)
    members = top_members(ranked, n, cohort, entity)
    long = long_metrics(members, metrics, [entity, cohort], cohort)
    keys = [cohort, "metric"]
    # At most n members per (cohort, metric): a sorted array is small by construction.
    values = F.array_sort(F.collect_list("value"))
    size = F.size("__v")
    cut0 = F.floor(size * F.lit(fraction)).cast("int")
    cut = F.when(size - 2 * cut0 >= 2, cut0).otherwise(0)
    kept = F.slice("__v", cut + 1, size - 2 * cut)
    stats = (
        long.groupBy(*keys)
        .agg(
            values.alias("__v"),
            F.avg("value").alias("arithmetic_mean"),
            F.median("value").alias("median"),
            F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
            F.count(F.lit(1)).alias("actual_n"),
            F.first("direction").alias("direction"),
        )
        .withColumn("mean", F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))
        .drop("__v")
    )
    pool = long_metrics(ranked, metrics, [entity, cohort], cohort)
    # The centroid is compared at 9 digits so that summation order cannot move a value
    # across an equal pool value.
    place = ecdf_position(
        pool.withColumn("value", F.round("value", 9)),
        stats.select(*keys, F.round("mean", 9).alias("__point")), keys, "value", "__point",
    )
    out = join_on(stats, place, keys, "left")
    if seed is not None:
        out = join_on(out, bootstrap_ci(long, keys, "value", seed, resamples, fraction), keys, "left")
    size_pool = ranked.groupBy(cohort).agg(F.count(F.lit(1)).alias("eligible_pool_n"))
    summary = join_on(
        members.groupBy(cohort).agg(
            F.count(F.lit(1)).alias("actual_n"),
            F.avg("rank_score").alias("mean_rank_score"),
            F.median("minutes").alias("median_minutes"),
        ),
        size_pool,
        [cohort],
    ).withColumn("sample_complete", F.col("actual_n") >= n)
    return out, summary


def cohort_best(ranked: DataFrame, cohort: str = "cohort", entity: str = "entity", exposure: str = "minutes") -> DataFrame:
    """First by rank, then smaller exposure, then id."""
    return latest_by_key(ranked, [cohort], [F.col("position_rank"), F.col(exposure), F.col(entity)])


def compare_to_best(centroids: DataFrame, best: DataFrame, metrics: DataFrame, cohort: str = "cohort", entity: str = "entity") -> DataFrame:
    """(centroid - best) x direction per metric and who leads."""
    real = long_metrics(best, metrics, [entity, cohort], cohort).select(cohort, "metric", entity, F.col("value").alias("real_value"))
    joined = centroids.select(cohort, "metric", "direction", F.col("mean").alias("avatar_value")).join(real, [cohort, "metric"])
    diff = F.round((F.col("avatar_value") - F.col("real_value")) * F.col("direction"), 9)
    return joined.select(
        "*",
        diff.alias("direction_adjusted_difference"),
        F.when(diff > 0, "centroid").when(diff < 0, "best").otherwise("tie").alias("leader"),
    )


def profile_dimensions(
    totals: DataFrame,
    counters: Sequence[str],
    ratios: Mapping[str, tuple[str, str]],
    composites: Mapping[str, Column],
    minimum: float = 450.0,
    exposure: str = "minutes",
) -> DataFrame:
    """Per-90 counters, guarded ratios and raw composites, each composite scaled to 0-1
    over the whole pool, and the exposure-driven uncertainty. ``composites`` maps a
    dimension to an expression over the rates."""
    pool = totals.where(F.col(exposure) >= minimum)
    rates = pool.select(
        "*",
        *[per_exposure(x, exposure).alias(f"{x}_p90") for x in counters],
        *[safe_ratio(a, b, zero=True).alias(n) for n, (a, b) in ratios.items()],
    )
    raw = rates.select("*", *[e.alias(f"{d}_raw") for d, e in composites.items()])
    scaled = robust_unit(raw, [], {d: f"{d}_raw" for d in composites})
    return scaled.withColumn("uncertainty", exposure_uncertainty(exposure))


def exposure_uncertainty(exposure: str) -> Column:
    base = F.lit(0.22) / F.sqrt(F.greatest(F.col(exposure) / 450.0, F.lit(1.0)))
    return clip(base, 0.035, 0.18)


def score_profiles(profiles: DataFrame, role: str, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Role-weighted overall score and the conservative score below it."""
    out = profiles.withColumn("overall", weighted_composite(role, weights))
    return out.withColumn("conservative_score", F.col("overall") - F.col("uncertainty"))


def pooled_centroid_team(
    players: DataFrame, n: int, mode: str, dims: Sequence[str], role: str = "role", entity: str = "entity"
) -> DataFrame:
    """Per role the trimmed mean (guard b) of each dimension over the top ``n``, with
    pooled uncertainty max(.025, mean/sqrt(n)) or the member median."""
    top = top_n_per_group(players, [role], [F.col("conservative_score").desc(), F.col("minutes").desc(), F.col(entity)], n)
    aggs = []
    for d in dims:
        v = F.array_sort(F.collect_list(d))
        size = F.size(v)
        cut0 = F.floor(size * F.lit(0.10)).cast("int")
        cut = F.when(size > 2 * cut0, cut0).otherwise(0)
        kept = F.slice(v, cut + 1, size - 2 * cut)
        aggs.append((F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)).alias(d))
    pooled = F.greatest(F.lit(0.025), F.avg("uncertainty") / F.sqrt(F.count(F.lit(1))))
    unc = pooled if mode == "pooled" else F.median("uncertainty")
    return top.groupBy(role).agg(F.count(F.lit(1)).alias("members"), *aggs, unc.alias("uncertainty"))


def squad_strength(
    totals: DataFrame, side: str, entity: str, raws: Mapping[str, Column], k: int = 18, minimum: float = 450.0
) -> DataFrame:
    """Attack, control and defence scaled over all entities; strength of a side is the
    exposure-weighted mean of its best ``k``, with its z-score over the sides."""
    from ..operators.aggregates import weighted_group_mean

    raw = totals.select("*", *[e.alias(f"{n}_raw") for n, e in raws.items()])
    unit = robust_unit(raw, [], {n: f"{n}_raw" for n in raws})
    # Weights of the three parts.
    strength = 0.42 * F.col("attack") + 0.25 * F.col("control") + 0.33 * F.col("defence")
    ready = unit.where(F.col("minutes") >= minimum).withColumn("strength", F.round(strength, 12))
    return weighted_group_mean(ready, side, entity, "strength", k, ["strength", "attack", "defence"])
