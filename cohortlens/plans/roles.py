"""Role inference from positional evidence and its reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import reason_precedence, weighted_composite
from ..operators import ordered
from ..operators.aggregates import distribution_string, mode_and_stability, spine_counts
from ..operators.ordered import join_on
from ..operators.tables import literal_table
from ..operators.windows import group_extent, line_index, order_rank
from ..presets.football import ROLES
from ..presets.formations import generic_rows, template_rows


def infer_roles(lineups: DataFrame) -> DataFrame:
    """Functional role of each starter of a line-up from provider code, grid and
    formation. ``lineups``: unit, side, entity, pos, row, col, formation; rows without a
    grid place get no role. All windows run inside one line-up."""
    team = Window.partitionBy("unit", "side")
    line = Window.partitionBy("unit", "side", "row")
    mid = F.when(F.col("pos") == "M", F.col("row"))
    # A starter without a grid place has no role, and is not counted in its line.
    seen = lineups.where(F.col("row").isNotNull() & F.col("col").isNotNull()).select(
        "*",
        F.count(F.lit(1)).over(line).alias("size"),
        F.min(mid).over(team).alias("mid_low"),
        F.max(mid).over(team).alias("mid_high"),
        F.size(F.collect_set(mid).over(team)).alias("mid_rows"),
    )
    size, row, pos = F.col("size"), F.col("row"), F.col("pos")
    edge = (size >= 3) & ((F.col("col") == 1) | (F.col("col") == size))
    lines = F.split("formation", "-")
    back_three = F.coalesce(F.try_element_at(lines, F.lit(1)).try_cast("int") == 3, F.lit(False)) & F.forall(
        lines, lambda x: (x == "") | x.try_cast("int").isNotNull()
    )
    layered = F.col("mid_rows") >= 2
    top, low = row == F.col("mid_high"), row == F.col("mid_low")
    role = (
        F.when((pos == "G") | (row == 1), "GK")
        .when((pos == "D") & (size >= 4) & edge, "FB")
        .when(pos == "D", "CB")
        .when((pos == "F") & edge, "W")
        .when(pos == "F", "ST")
        .when((pos == "M") & F.coalesce(back_three, F.lit(False)) & (F.col("mid_rows") == 1) & (size >= 4) & edge, "FB")
        .when((pos == "M") & layered & edge & top, "W")
        .when((pos == "M") & layered & low, "DM")
        .when((pos == "M") & layered & top, "AM")
        .when(pos == "M", "CM")
    )
    return seen.select(*lineups.columns, role.alias("role")).where(F.col("role").isNotNull())


def _order_of(role: str, roles: Sequence[str]) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(r) for r in roles]), F.col(role)), F.lit(999))


def primary_role(evidence: DataFrame, roles: Sequence[str] = ROLES, minimum_share: float = 0.60) -> DataFrame:
    """Role with the most exposure (ties in role order) and its share; ambiguous below
    the minimum. ``evidence``: entity, role, minutes."""
    per = evidence.groupBy("entity", "role").agg(F.sum("minutes").alias("m"))
    place = _order_of("role", roles)
    out = per.groupBy("entity").agg(
        F.min(F.struct((-F.col("m")).alias("m"), place.alias("o"), F.col("role").alias("role"))).alias("b"), F.sum("m").alias("total")
    )
    share = -F.col("b.m") / F.col("total")
    return out.where(F.col("total") > 0).select(
        "entity",
        F.col("b.role").alias("primary_role"),
        share.alias("role_share"),
        F.col("total").alias("precise_minutes"),
        (share < minimum_share).alias("ambiguous"),
    )


def attribute_to_role(appearances: DataFrame, starts: DataFrame, primary: DataFrame) -> DataFrame:
    """Every appearance goes to the entity's stable primary role. ``starts`` has the
    precise role of a start by (entity, unit); ``source`` tells how the two agree, and
    appearances without a stable role carry ``excluded``."""
    stable = primary.where(~F.col("ambiguous")).select("entity", "primary_role", "role_share")
    rows = join_on(join_on(appearances, starts, ["entity", "unit"], "left"), stable, ["entity"], "left")
    source = (
        F.when(F.col("primary_role").isNull(), "excluded")
        .when(F.col("role").isNull(), "recovered")
        .when(F.col("role") == F.col("primary_role"), "consistent")
        .otherwise("reassigned")
    )
    return rows.withColumn("source", source)


def attribute_starters_only(appearances: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only appearances with a precise starting role are kept; also role counts with the
    excluded rows under a null role."""
    rows = join_on(appearances, starts, ["entity", "unit"], "left")
    return rows.where(F.col("role").isNotNull()), rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def role_rules(band: Column, grid_row: Column, squad: Column, provider: Column) -> Column:
    """Role from squad or provider code, grid band and the profile dimensions."""
    is_ = lambda s, p: F.coalesce(squad == s, F.lit(False)) | F.coalesce(provider == p, F.lit(False))
    wide = F.coalesce(band.startswith("outer"), F.lit(False)) & (grid_row.isNull() | (grid_row <= 2.5))
    wing = F.col("progression") + F.col("creation") - F.col("finishing")
    attack = 0.55 * F.col("creation") + 0.45 * F.col("progression")
    defence = 0.62 * F.col("defending") + 0.38 * F.col("duels")
    return (
        F.when(is_("Goalkeeper", "G"), "GK")
        .when(is_("Defender", "D"), F.when(wide, "FB").otherwise("CB"))
        .when(is_("Attacker", "F"), F.when(wing > 0.18, "W").otherwise("ST"))
        .when(defence - attack > 0.18, "DM")
        .when(attack - defence > 0.20, "AM")
        .otherwise("CM")
    )


# Weights of the signal that splits each broad group.
GROUP_SIGNALS = {
    "D": {"progression": 0.42, "creation": 0.28, "build_up": 0.15, "defending": -0.10, "duels": -0.05},
    "M": {"creation": 0.55, "progression": 0.45, "defending": -0.58, "duels": -0.42},
    "F": {"finishing": 1.0, "duels": 0.20, "progression": -0.42, "creation": -0.28},
}


def role_by_cohort_percentile(profiles: DataFrame, group: str = "broad") -> DataFrame:
    """Role from the average-rank percentile of a group signal; keepers stay keepers."""
    signal = None
    for g, weights in GROUP_SIGNALS.items():
        terms = [F.lit(w) * F.col(d) for d, w in weights.items()]
        value = F.round(sum(terms[1:], terms[0]), 9)
        signal = F.when(F.col(group) == g, value) if signal is None else signal.when(F.col(group) == g, value)
    ranked = ordered.pct_rank_avg(profiles.withColumn("__s", signal), [group], "__s", "signal_pct")
    p, g = F.col("signal_pct"), F.col(group)
    role = (
        F.when(g == "G", "GK")
        .when(g == "D", F.when(p >= 0.56, "FB").otherwise("CB"))
        .when(g == "F", F.when(p >= 0.60, "ST").otherwise("W"))
        .when(p <= 0.30, "DM")
        .when(p >= 0.70, "AM")
        .otherwise("CM")
    )
    return ranked.withColumn("role", role).drop("__s")


def side_of(x: Column, mapping: str | None) -> Column:
    low = x <= 0.5
    if mapping == "low_is_left":
        return F.when(low, "L").otherwise("R")
    if mapping == "low_is_right":
        return F.when(low, "R").otherwise("L")
    return F.when(low, "LOW").otherwise("HIGH")


def side_role(x: Column, depth: Column, mapping: str | None, code: Column) -> Column:
    """One of eleven roles from the broad code (G/D/F/other), the normalised column and
    the depth; without a validated mapping the side stays LOW or HIGH."""
    z = side_of(x, mapping)
    sided = lambda tail, head: F.concat(z, F.lit(tail)) if mapping else F.concat(F.lit(head), z)
    outer = (x <= 0.34) | (x >= 0.82)
    return (
        F.when(code == "G", "GK")
        .when((code == "D") & outer, sided("B", "FB_"))
        .when(code == "D", sided("CB", "CB_"))
        .when((code == "F") & outer, sided("W", "W_"))
        .when(code == "F", "ST")
        .when(depth <= 0.38, "DM")
        .when(depth >= 0.70, "AM")
        .otherwise("CM")
    )


def resolve_side_roles(starts: DataFrame, mapping: str | None, coverage: DataFrame, minimum: float = 900.0) -> DataFrame:
    """Modal side role per entity with stability, counts, distribution text, and
    eligibility (stable, covered, enough exposure). ``starts``: unit, side, entity, code,
    row, col. ``coverage``: entity, reported_minutes, covered."""
    placed = group_extent(starts)
    x = F.col("col") / F.col("row_width")
    seen = placed.withColumn("obs_role", side_role(x, F.col("depth"), mapping, F.col("code")))
    modal = mode_and_stability(seen, ["entity"], "obs_role")
    text = distribution_string(seen, ["entity"], "obs_role")
    out = join_on(join_on(modal, text, ["entity"]), coverage, ["entity"], "left")
    stable = F.col("stability") >= 0.6
    return out.select(
        "entity",
        F.col("mode").alias("resolved_role"),
        F.col("stability").alias("role_stability"),
        F.col("observations").alias("role_observations"),
        "distribution",
        stable.alias("stable_role"),
        (stable & F.coalesce("covered", F.lit(False)) & (F.coalesce("reported_minutes", F.lit(0.0)) >= minimum)).alias("eligible"),
    )


def validate_orientation(observations: DataFrame, anchors: DataFrame) -> DataFrame:
    """Two candidate mappings of the low and high grid bands scored on anchored entities,
    by observations and by per-entity majority. ``observations``: entity, x.
    ``anchors``: entity, expected_side. The middle band is dropped."""
    band = F.when(F.col("x") <= 0.34, "low").when(F.col("x") >= 0.76, "high")
    seen = observations.withColumn("band", band).where(F.col("band").isNotNull()).join(anchors, "entity")
    hit = lambda low, high: (F.when(F.col("band") == "low", low).otherwise(high) == F.col("expected_side")).cast("double")
    tries = F.array(
        F.struct(F.lit("low_is_left").alias("mapping"), hit("L", "R").alias("ok")),
        F.struct(F.lit("low_is_right").alias("mapping"), hit("R", "L").alias("ok")),
    )
    per = seen.select("entity", F.inline(tries)).groupBy("mapping", "entity").agg(
        F.sum("ok").alias("ok"), F.count(F.lit(1)).alias("n")
    )
    out = per.groupBy("mapping").agg(
        F.count(F.lit(1)).alias("anchors"),
        F.sum("n").alias("observations"),
        (F.sum("ok") / F.sum("n")).alias("observation_agreement"),
        F.avg((F.col("ok") / F.col("n") >= 0.5).cast("double")).alias("entity_agreement"),
    )
    return out.withColumn(
        "accepted",
        (F.col("anchors") >= 5) & (F.col("observations") >= 15) & (F.col("observation_agreement") >= 0.8) & (F.col("entity_agreement") >= 0.8),
    )


def template_roles(starts: DataFrame) -> DataFrame:
    """Role from the formation template by (line, size, place); a generic table by line
    kind where no template fits; else unresolved. ``starts``: unit, side, entity,
    formation, row, col."""
    spark = starts.sparkSession
    templates = literal_table(
        spark, [("formation", "string"), ("line", "int"), ("line_size", "int"), ("place", "int"), ("t_role", "string")], template_rows()
    )
    generic = literal_table(spark, [("kind", "string"), ("line_size", "int"), ("place", "int"), ("g_role", "string")], generic_rows())
    clean = starts.withColumn("formation", F.regexp_replace(F.coalesce("formation", F.lit("")), " ", ""))
    keepers = clean.where(F.col("row") == 1).select(
        "unit", "side", "entity", "formation", F.lit("GK").alias("role"), F.lit("goalkeeper_grid").alias("method")
    )
    parts = F.filter(F.split("formation", "-"), lambda x: x != "")
    n = F.size(parts)
    kind = (
        F.when(F.col("line") == 1, "first")
        .when(F.col("line") == n, "last")
        .when((F.col("line") == 2) & (F.try_element_at(parts, F.lit(1)) == "3"), "wing")
        .when(F.col("line") == 2, "second")
        .otherwise("later")
    )
    lines = line_index(clean, ["unit", "side"]).withColumn("kind", kind)
    joined = lines.join(templates, ["formation", "line", "line_size", "place"], "left").join(generic, ["kind", "line_size", "place"], "left")
    has_line = F.col("t_role").isNotNull()
    outfield = joined.select(
        "unit", "side", "entity", "formation",
        F.coalesce("t_role", "g_role", F.lit("UNRESOLVED")).alias("role"),
        F.when(has_line, "formation_template").otherwise("formation_generic").alias("method"),
    )
    return keepers.unionByName(outfield)


def aggregate_template_roles(evidence: DataFrame, current: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Exposure-weighted primary role per entity. A raw ``CB`` takes the side of the
    current role. ``evidence``: entity, unit, role, minutes; ``current``: entity,
    current_role. ``current`` may be as long as the evidence and is never broadcast: an
    estimate made before an explode would take it for a small table."""
    usable = evidence.where(F.col("role") != "UNRESOLVED")
    per = usable.groupBy("entity", "role").agg(
        F.sum(F.coalesce("minutes", F.lit(0.0))).alias("m"), F.countDistinct("unit").alias("n")
    )
    # One entry per distinct role of an entity.
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), (-F.col("n")).alias("n"), F.col("role").alias("role"))))
    agg = per.groupBy("entity").agg(ranked.alias("r"), F.sum("m").alias("total"), F.sum("n").alias("observations"))
    text = F.transform(
        "r", lambda x: F.concat(x["role"], F.lit(":"), F.round(-x["m"]).cast("bigint").cast("string"), F.lit("m/"), (-x["n"]).cast("string"))
    )
    out = join_on(agg, current.hint("merge"), ["entity"], "left")
    raw = F.col("r")[0]["role"]
    primary = F.when(raw == "CB", F.when(F.col("current_role").isin("RCB", "LCB"), F.col("current_role"))).when(raw.isin(*roles), raw)
    return out.select(
        "entity",
        raw.alias("raw_role"),
        primary.alias("formation_role"),
        F.when(F.col("total") > 0, -F.col("r")[0]["m"] / F.col("total")).otherwise(0.0).alias("stability"),
        F.col("total").alias("precise_minutes"),
        "observations",
        F.array_join(text, " | ").alias("distribution"),
    )


def reconcile_role_evidence(rows: DataFrame, broad: Mapping[str, str], weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Audited role by precedence of template, public anchor and current role; conflict
    and eligibility flags; score and rank under the audited role.

    ``rows``: entity, current_role, formation_role, allowed (pipe list or null),
    preferred, minutes, uncertainty, and the profile dimensions."""
    allowed = F.filter(F.split(F.coalesce("allowed", F.lit("")), r"\|"), lambda x: x != "")
    has = F.size(allowed) > 0
    inside = lambda c: F.coalesce(F.array_contains(allowed, F.col(c)), F.lit(False))
    form = F.col("formation_role")
    single = F.size(allowed) == 1
    method = reason_precedence(
        [
            (has & inside("formation_role"), "formation_and_public_agree"),
            (has & inside("preferred"), "public_preferred_override"),
            (has & single, "single_public_role_override"),
            (has & inside("current_role"), "current_role_publicly_allowed"),
            (has, "public_anchor_unresolved_conflict"),
            (form.isNotNull(), "formation_only"),
        ],
        "current_fallback",
    )
    role = (
        F.when(F.col("method").isin("formation_and_public_agree", "formation_only"), form)
        .when(F.col("method") == "public_preferred_override", F.col("preferred"))
        .when(F.col("method") == "single_public_role_override", allowed[0])
        .when(F.col("method").isin("current_role_publicly_allowed", "current_fallback"), F.col("current_role"))
    )
    out = rows.withColumn("method", method).withColumn("audited_role", role)
    group = None
    for r, b in broad.items():
        group = F.when(F.col("audited_role") == r, b) if group is None else group.when(F.col("audited_role") == r, b)
    out = out.withColumn("__b", group)
    out = out.withColumn("audited_score", F.round(weighted_composite("__b", weights) - F.col("uncertainty"), 9)).drop("__b")
    out = out.withColumn("changed", ~F.col("audited_role").eqNullSafe(F.col("current_role"))).withColumn(
        "conflict", F.col("method") == "public_anchor_unresolved_conflict"
    )
    order = [F.col("audited_score").desc_nulls_last(), F.col("minutes").desc(), F.col("entity")]
    return order_rank(out, ["audited_role"], order, "audited_rank")


def high_impact_set(members: DataFrame, real: DataFrame) -> DataFrame:
    """Entities used by the current release: pooled top members and identified ones."""
    return members.select("entity").union(real.select("entity")).distinct()


def convergence_check(evidence: DataFrame, ranks: DataFrame) -> DataFrame:
    """External evidence beside the audited rank; entities without a rank are reported."""
    return evidence.join(ranks, "entity", "left").withColumn("rank_missing", F.col("audited_rank").isNull())


def role_counts(resolved: DataFrame, spine: DataFrame) -> DataFrame:
    return spine_counts(resolved.where("eligible").withColumnRenamed("resolved_role", "role"), "role", "entity", spine)


