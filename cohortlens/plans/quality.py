"""Blind review, pilot quality and the yearly coverage decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators.joins import validated_join
from ..operators.ordered import join_on, row_index
from ..operators.resample import scatter
from ..operators.tables import literal_table
from ..operators.windows import first_last_sample, top_n_per_group


def _shuffled(seed: int, entity: str) -> list[Column]:
    return [scatter(seed, F.col(entity), F.lit(0)), F.col(entity)]


def blind_sample(
    frame: DataFrame, roles: Sequence[str], seed: int, per_role: int = 10, unresolved: int = 20, entity: str = "entity"
) -> tuple[DataFrame, DataFrame]:
    """All mandatory rows, up to ``per_role`` further ones of each role and
    ``unresolved`` without a usable role, in shuffled order with review ids. Returns the
    packet without roles, and the answer key. The order is a hash of (seed, id), so the
    draw can be repeated. ``frame``: entity, role, mandatory."""
    resolved = F.col("role").isin(*roles)
    rest = frame.where(~F.col("mandatory"))
    by_role = top_n_per_group(rest.where(resolved), ["role"], _shuffled(seed, entity), per_role)
    blank = rest.where(F.col("role").isNull() | ~resolved)
    others = blank.orderBy(*_shuffled(seed + 1, entity)).limit(unresolved)
    chosen = frame.where("mandatory").unionByName(by_role).unionByName(others).dropDuplicates([entity])
    numbered = row_index(chosen, [], _shuffled(seed + 2, entity), "__n")
    key = numbered.withColumn("review_id", F.format_string("PR-%04d", F.col("__n"))).drop("__n")
    return key.drop("role", "mandatory"), key


def review_agreement(a: DataFrame, b: DataFrame, key: DataFrame, labels: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Two reviewers joined 1:1 by review id: agreement, kappa, agreement on the
    high-impact part, compatibility with public anchors, and the gate; plus the
    confusion matrix. ``a``/``b``: review_id, role; ``key``: review_id, high_impact,
    allowed (pipe list or null)."""
    clean = lambda df, n: df.select("review_id", F.upper(F.trim("role")).alias(n))
    both = validated_join(clean(a, "role_a"), clean(b, "role_b"), ["review_id"], how="inner", one_to_one=True)
    rows = validated_join(both, key, ["review_id"]).withColumn("agree", F.col("role_a") == F.col("role_b"))
    fits = F.array_contains(F.split("allowed", r"\|"), F.col("role_a"))
    anchored = F.col("allowed").isNotNull() & F.col("agree")
    parts = rows.agg(
        F.avg(F.col("agree").cast("double")).alias("agreement"),
        F.avg(F.when(F.col("high_impact"), F.col("agree").cast("double"))).alias("high_impact_agreement"),
        F.coalesce(F.avg(F.when(anchored, fits.cast("double"))), F.lit(0.0)).alias("public_compatibility"),
        F.count_if(F.col("high_impact") & ~F.col("agree")).alias("unresolved_high_impact"),
    )
    kappa = A.cohen_kappa(rows, "role_a", "role_b").select("n", "kappa")
    gate = (
        (F.col("kappa") >= 0.80)
        & (F.col("high_impact_agreement") >= 0.90)
        & (F.col("public_compatibility") >= 0.90)
        & (F.col("unresolved_high_impact") == 0)
    )
    spine = literal_table(rows.sparkSession, [("label", "string")], [(x,) for x in labels])
    return join_on(parts, kappa, []).withColumn("passed", gate), A.confusion_matrix(rows, "role_a", "role_b", labels, spine)


def pilot_quality(units: DataFrame, flags: dict[str, Column], thresholds: Sequence[tuple[str, str, float]]) -> tuple[DataFrame, DataFrame]:
    """First and last unit of each (league, season): endpoint rates per group, and the
    overall rates against the thresholds."""
    sample = first_last_sample(units, ["league", "season"], ["ts", "unit"])
    rates = A.endpoint_rates(sample, ["league", "season"], flags)
    overall = sample.agg(*[F.avg(t.cast("double")).alias(f"{n}_rate") for n, t in flags.items()])
    limits = literal_table(units.sparkSession, [("metric", "string"), ("kind", "string"), ("threshold", "double")], thresholds)
    return rates, A.gate_table(overall, limits)


# Thresholds of the yearly decision.
HARD = {"any_rate": 0.98, "both_rate": 0.95, "detail_share": 0.85, "min_cohort_any_rate": 0.95}
FAIR = {"min_side_any_rate": 0.85, "min_side_detail_share": 0.80}


def annual_coverage_decision(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overall and worst-group coverage rates, and the three-way status: approved,
    approved with repairs, or review; plus the groups below a fairness threshold.
    ``entities``: entity, side, cohort, any_row, both_seasons, minutes, detail_minutes."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    share = F.sum("detail_minutes") / F.sum("minutes")
    total = entities.agg(rate("any_row").alias("any_rate"), rate("both_seasons").alias("both_rate"), share.alias("detail_share"))
    side = entities.groupBy("side").agg(rate("any_row").alias("any_rate"), share.alias("detail_share"))
    cohort = entities.groupBy("cohort").agg(rate("any_row").alias("any_rate"))
    metrics = join_on(
        join_on(total, side.agg(F.min("any_rate").alias("min_side_any_rate"), F.min("detail_share").alias("min_side_detail_share")), []),
        cohort.agg(F.min("any_rate").alias("min_cohort_any_rate")),
        [],
    )
    ok = lambda table: [F.coalesce(F.col(k) >= v, F.lit(False)) for k, v in table.items()]
    every = lambda tests: F.forall(F.array(*tests), lambda x: x)
    hard, fair = every(ok(HARD)), every(ok(FAIR))
    status = F.when(hard & fair, "approved").when(hard, "approved_with_repairs").otherwise("review_required")
    below = side.where((F.col("any_rate") < FAIR["min_side_any_rate"]) | (F.col("detail_share") < FAIR["min_side_detail_share"]))
    return metrics.withColumn("status", status), below
