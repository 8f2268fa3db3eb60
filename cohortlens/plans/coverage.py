"""Coverage ledgers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip, safe_ratio
from ..operators.aggregates import count_if, zsum
from ..operators.filters import window_membership
from ..operators.ordered import join_on
from ..operators.windows import latest_by_key

PASS = 0.80


def exit_events(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First substitution-out or red card minute per key, clipped to 0-130."""
    kind, detail = F.lower("event_type"), F.lower(F.coalesce("detail", F.lit("")))
    leaves = (kind == "subst") | ((kind == "card") & detail.contains("red"))
    return (
        events.where(leaves & F.col("elapsed").isNotNull())
        .groupBy(*keys)
        .agg(F.min(clip("elapsed", 0.0, 130.0)).alias("exit_minute"))
    )


def entity_spine(entities: DataFrame, windows: Sequence[str], entity: str = "entity") -> DataFrame:
    """Every entity with every window name."""
    return entities.select("*", F.explode(F.array(*[F.lit(w) for w in windows])).alias("window"))


def dedupe_details(details: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per (unit, entity), the last in ``order``."""
    return latest_by_key(details, ["unit", "entity"], [F.col(x).desc() for x in order])


def coverage_ledger(
    entities: DataFrame,
    expected: DataFrame,
    processed: DataFrame,
    details: DataFrame,
    windows: Sequence[str],
    reported_window: str,
) -> DataFrame:
    """Ledger v1. ``entities``: entity, reported_minutes. ``expected``: entity, window,
    unit. ``processed``: unit. ``details``: entity, window, unit, minutes (one row per
    pair). Exposure is reconciled with the reported total in one window only."""
    done = processed.select("unit").distinct().withColumn("__done", F.lit(1))
    marked = join_on(expected, done, ["unit"], "left")
    per = marked.groupBy("entity", "window").agg(
        F.count(F.lit(1)).alias("expected"), F.count("__done").alias("processed")
    )
    have = details.groupBy("entity", "window").agg(
        F.countDistinct("unit").alias("detail_units"), F.sum("minutes").alias("detail_minutes")
    )
    keys = ["entity", "window"]
    base = join_on(join_on(entity_spine(entities, windows), per, keys, "left"), have, keys, "left")
    zero = lambda c, z=0: F.coalesce(F.col(c), F.lit(z))
    base = base.select(
        "entity",
        "window",
        zero("expected").alias("expected"),
        zero("processed").alias("processed"),
        zero("detail_units").alias("detail_units"),
        zero("detail_minutes", 0.0).alias("detail_minutes"),
        F.when(F.col("window") == reported_window, F.col("reported_minutes")).alias("reported_minutes"),
    )
    raw = safe_ratio("detail_minutes", "reported_minutes")
    out = base.select(
        "*",
        (F.col("expected") - F.col("processed")).alias("missing"),
        safe_ratio("processed", "expected").alias("unit_coverage"),
        raw.alias("minute_ratio_raw"),
        clip(raw, 0.0, 1.0).alias("minute_ratio_clipped"),
    )
    ok = (F.col("unit_coverage") >= PASS) & (F.col("minute_ratio_clipped").isNull() | (F.col("minute_ratio_clipped") >= PASS))
    return out.withColumn("passed", F.coalesce(ok, F.lit(False)))


def missing_units(expected: DataFrame, processed: DataFrame, ledger: DataFrame) -> DataFrame:
    """Units still missing for entities that do not pass, once each."""
    gaps = expected.join(processed.select("unit"), "unit", "left_anti")
    failing = ledger.where(~F.col("passed")).select("entity", "window")
    return gaps.join(failing, ["entity", "window"], "left_semi").select("entity", "window", "unit").distinct()


def bounded_coverage_ledger(
    entities: DataFrame,
    expected: DataFrame,
    processed: DataFrame,
    details: DataFrame,
    starters: DataFrame,
    exits: DataFrame,
    unit_max: DataFrame,
    windows: Sequence[str],
) -> DataFrame:
    """Ledger v2: a starter without a detail row counts as missing exposure, bounded by
    the exit minute or the length of the unit.

    ``details``: entity, unit, minutes (positive, one per pair). ``starters``: entity,
    unit. ``exits``: entity, unit, exit_minute. ``unit_max``: unit, max_minutes. All
    evidence meets the expected pairs on (entity, unit), so each table is shuffled once
    and no entity's rows are gathered anywhere."""
    pair = ["entity", "unit"]
    done = processed.select("unit").distinct().withColumn("__done", F.lit(1))
    have = details.groupBy(*pair).agg(F.sum("minutes").alias("__minutes"))
    start = starters.select(*pair).distinct().withColumn("__start", F.lit(1))
    rows = join_on(expected, have, pair, "left")
    rows = join_on(rows, start, pair, "left")
    rows = join_on(rows, exits.select(*pair, "exit_minute"), pair, "left")
    rows = join_on(join_on(rows, unit_max, ["unit"], "left"), done, ["unit"], "left")
    absent = F.col("__start").isNotNull() & F.col("__minutes").isNull()
    bound = F.greatest(F.least(F.coalesce("exit_minute", "max_minutes"), F.col("max_minutes")), F.lit(0.0))
    per = rows.groupBy("entity", "window").agg(
        F.count(F.lit(1)).alias("expected"),
        F.count("__done").alias("processed"),
        F.count("__minutes").alias("detail_units"),
        zsum("__minutes").alias("detail_minutes"),
        F.count("__start").alias("known_starts"),
        count_if(absent).alias("missing_starts"),
        zsum(F.when(absent, bound)).alias("missing_minutes_bound"),
        count_if(absent & F.col("exit_minute").isNotNull()).alias("missing_starts_with_exit"),
    )
    out = join_on(entity_spine(entities.select("entity"), windows), per, ["entity", "window"], "left")
    counts = ["expected", "processed", "detail_units", "known_starts", "missing_starts", "missing_starts_with_exit"]
    out = out.select(
        "entity",
        "window",
        *[F.coalesce(x, F.lit(0)).alias(x) for x in counts],
        *[F.coalesce(x, F.lit(0.0)).alias(x) for x in ("detail_minutes", "missing_minutes_bound")],
    )
    total = F.col("detail_minutes") + F.col("missing_minutes_bound")
    lower = F.when(total > 0, F.col("detail_minutes") / total).otherwise(1.0)
    out = out.select("*", safe_ratio("processed", "expected").alias("unit_coverage"), lower.alias("minute_coverage_lower"))
    ok = (F.col("unit_coverage") >= PASS) & (F.col("minute_coverage_lower") >= PASS)
    return out.withColumn("passed", F.coalesce(ok, F.lit(False)))


def merge_minutes(ledger: DataFrame, caches: DataFrame, unit_flags: DataFrame, windows: Mapping[str, str], reported_window: str) -> DataFrame:
    """Largest exposure per (entity, unit) over all caches, clipped to 0-130, totalled
    per window; a ledger minute is never lost; pass before and after."""
    pairs = caches.groupBy("entity", "unit").agg(F.max(clip(F.coalesce("minutes", F.lit(0.0)), 0.0, 130.0)).alias("minutes"))
    official = pairs.join(unit_flags.where("official"), "unit")
    totals = window_membership(official, windows).groupBy("entity", "window").agg(
        F.count(F.lit(1)).alias("__u"), F.sum("minutes").alias("__m")
    )
    out = join_on(ledger, totals, ["entity", "window"], "left")
    minutes = F.greatest(F.col("detail_minutes"), F.coalesce("__m", F.lit(0.0)))
    ratio = safe_ratio(minutes, "reported_minutes")
    reported_ok = (F.col("window") != reported_window) | F.col("reported_minutes").isNull() | (ratio >= PASS)
    passed = F.coalesce((F.col("unit_coverage") >= PASS) & reported_ok, F.lit(False))
    return out.select(
        "entity",
        "window",
        "detail_minutes",
        minutes.alias("merged_minutes"),
        F.greatest(F.col("detail_units"), F.coalesce("__u", F.lit(0))).alias("merged_units"),
        F.greatest(minutes - F.col("detail_minutes"), F.lit(0.0)).alias("recovered_minutes"),
        F.col("passed").alias("passed_before"),
        passed.alias("passed_after"),
    )


def merge_gate(merged: DataFrame, mapping_rate: float = 1.0) -> DataFrame:
    """Whether the merged ledger may replace the old one."""
    return merged.agg(
        F.count_if("passed_before").alias("before"),
        F.count_if("passed_after").alias("after"),
        F.sum("recovered_minutes").alias("recovered_minutes"),
    ).withColumn(
        "safe", (F.col("after") >= F.col("before")) & (F.col("recovered_minutes") > 0) & F.lit(mapping_rate >= 0.95)
    )


def reconstruct_exposure(pairs: DataFrame, lineups: DataFrame, events: DataFrame, meta: DataFrame) -> DataFrame:
    """Exposure of (entity, unit) pairs from line-ups and events.

    Starter with an exit: the exit minute (grade A). Starter without one: the whole unit
    when both line-ups are complete, the feed is there and the side made a substitution
    (grade B). Substitute with an entry: from entry to exit or end (grade A). Anything
    else stays unresolved with a reason. Events are reduced to one row per (unit,
    entity) and per (unit, side) before they meet the pairs."""
    ev = events.where(F.col("elapsed").isNotNull())
    kind, detail = F.lower("event_type"), F.lower(F.coalesce("detail", F.lit("")))
    is_sub = kind == "subst"
    is_red = (kind == "card") & (detail.contains("red") | detail.contains("second yellow"))
    exits = ev.where(is_sub | is_red).groupBy("unit", F.col("player_id").alias("entity")).agg(F.min("elapsed").alias("__exit"))
    entries = ev.where(is_sub).groupBy("unit", F.col("assist_id").alias("entity")).agg(F.min("elapsed").alias("__entry"))
    subs = events.where(is_sub).groupBy("unit", "side").agg(F.count(F.lit(1)).alias("__subs"))
    starter = F.lower("source") == "startxi"
    seats = lineups.groupBy("unit", "entity").agg(
        F.max(F.struct(starter.alias("starter"), F.col("side").alias("side"))).alias("__seat")
    )
    rows = join_on(pairs, seats, ["unit", "entity"], "left").withColumn("side", F.col("__seat.side"))
    rows = join_on(join_on(rows, exits, ["unit", "entity"], "left"), entries, ["unit", "entity"], "left")
    rows = join_on(join_on(rows, subs, ["unit", "side"], "left"), meta, ["unit"], "left")
    limit = F.when(F.col("status").isin("AET", "PEN"), 120.0).otherwise(90.0)
    exit_at = clip(F.col("__exit").cast("double"), F.lit(0.0), limit)
    entry_at = clip(F.col("__entry").cast("double"), F.lit(0.0), limit)
    full = (
        F.coalesce(F.col("status").isin("FT", "AET", "PEN"), F.lit(False))
        & (F.coalesce("home_starters", F.lit(0)) >= 11)
        & (F.coalesce("away_starters", F.lit(0)) >= 11)
        & (F.coalesce("event_count", F.lit(0)) > 0)
        & (F.coalesce("__subs", F.lit(0)) > 0)
    )
    is_starter = F.col("__seat.starter")
    end = F.when(exit_at >= entry_at, exit_at).otherwise(limit)
    minutes = (
        F.when(is_starter & exit_at.isNotNull(), exit_at)
        .when(is_starter & full, limit)
        .when(~is_starter & entry_at.isNotNull(), F.greatest(end - entry_at, F.lit(0.0)))
    )
    positive = F.when(minutes > 0, minutes)
    grade = F.when(is_starter & exit_at.isNull(), "B").otherwise("A")
    return rows.select(
        *pairs.columns,
        positive.alias("minutes"),
        F.when(positive.isNotNull(), grade).alias("grade"),
        F.when(F.col("__seat").isNull(), "absent_from_lineup")
        .when(positive.isNull(), "insufficient_evidence")
        .alias("reason"),
    )


def integrate_reconstructed(ledger: DataFrame, reconstructed: DataFrame) -> DataFrame:
    """Splits the ledger's exposure into provider and reconstructed minutes and labels
    the rows that changed definition. ``ledger`` was rebuilt over the union of both."""
    per = reconstructed.groupBy("entity", "window").agg(
        F.sum("minutes").alias("reconstructed_minutes"), F.countDistinct("unit").alias("reconstructed_units")
    )
    out = join_on(ledger, per, ["entity", "window"], "left")
    rec = F.coalesce("reconstructed_minutes", F.lit(0.0))
    units = F.coalesce("reconstructed_units", F.lit(0))
    return out.select(
        *ledger.columns,
        rec.alias("reconstructed_minutes"),
        units.alias("reconstructed_units"),
        F.greatest(F.col("detail_minutes") - rec, F.lit(0.0)).alias("provider_minutes"),
        F.when(units > 0, "v3_reconstructed").otherwise("v2_bounded").alias("version"),
    )


def rebuild_pair_ledger(details: DataFrame, lineups: DataFrame, units: DataFrame) -> DataFrame:
    """Every (entity, unit) pair of either source with the first non-null value of each
    field, and its status. Grouped over the union of both sources: one shuffle, no outer
    join."""
    a = details.select("entity", "unit", "side", "minutes", F.lit(False).alias("starter"))
    b = lineups.select("entity", "unit", F.col("side").alias("side_lineup"), (F.lower("source") == "startxi").alias("starter"))
    both = a.unionByName(b, allowMissingColumns=True)
    pairs = both.groupBy("entity", "unit").agg(
        F.coalesce(F.min("side"), F.min("side_lineup")).alias("side"),
        F.max("minutes").alias("minutes"),
        F.max("starter").alias("starter"),
    )
    out = join_on(pairs, units, ["unit"], "left")
    detail = F.coalesce(F.col("minutes") > 0, F.lit(False))
    status = F.when(detail, "detailed").when(F.col("starter"), "lineup_only_start").otherwise("no_positive_row")
    return out.select("*", detail.alias("detailed"), status.alias("pair_status"))


def pair_summary(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("entity").agg(
        F.count(F.lit(1)).alias("pairs"),
        count_if(F.col("detailed")).alias("detailed_pairs"),
        zsum("minutes").alias("minutes"),
        count_if(F.col("starter")).alias("start_pairs"),
        count_if(F.col("pair_status") == "lineup_only_start").alias("missing_start_pairs"),
    )


def minute_ledger_diff(old: DataFrame, new: DataFrame, threshold: float = PASS) -> DataFrame:
    """Entities of both ledgers classified by whether each share reaches the threshold."""
    j = old.join(new, "entity")
    o, n = F.coalesce(F.col("old_share") >= threshold, F.lit(False)), F.coalesce(F.col("new_share") >= threshold, F.lit(False))
    label = F.when(n, "current_passes").when(o & ~n, "only_in_old").otherwise("both_below")
    return j.select(
        "entity",
        "old_share",
        "new_share",
        F.greatest(F.col("old_minutes") - F.col("new_minutes"), F.lit(0.0)).alias("minutes_not_current"),
        label.alias("classification"),
    )


# Weights of the selection reasons and of the two kinds of gap.
REASON_WEIGHT = {
    "covered_pool_shortage": 6.0,
    "upper90_can_enter_real_xi": 5.0,
    "high_ability_role_stabilization": 4.5,
    "upper90_can_enter_top30": 3.5,
    "top35_guardrail": 2.5,
}
GAP_WEIGHT = {"missing_unit": 2.0, "start_without_detail": 1.5}


def lookup(col: str, table: Mapping[str, float], default: float = 1.0):
    out = None
    for k, v in table.items():
        out = F.when(F.col(col) == k, v) if out is None else out.when(F.col(col) == k, v)
    return out.otherwise(default)


def residual_queue(
    needed: DataFrame, expected: DataFrame, processed: DataFrame, starters: DataFrame, details: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Gaps of the entities still needed (``needed``: entity, reason): expected units
    not processed, and starts without a detail row; weighted, and summed per unit."""
    exp = expected.join(needed, "entity")
    missing = exp.join(processed.select("unit"), "unit", "left_anti").withColumn("gap", F.lit("missing_unit"))
    pair = ["entity", "unit"]
    bare = starters.select(*pair).distinct().join(details.where(F.col("minutes") > 0).select(*pair), pair, "left_anti")
    known = exp.join(bare, pair, "left_semi").withColumn("gap", F.lit("start_without_detail"))
    queue = (
        missing.unionByName(known)
        .select("entity", "unit", "window", "reason", "gap")
        .distinct()
        .withColumn("priority", lookup("reason", REASON_WEIGHT) + lookup("gap", GAP_WEIGHT))
    )
    per_unit = queue.groupBy("unit").agg(
        F.countDistinct("entity").alias("entities"),
        F.count(F.lit(1)).alias("pairs"),
        F.max("priority").alias("max_priority"),
        F.sum("priority").alias("total_priority"),
    ).withColumn("information_value", F.col("max_priority") + 0.5 * F.col("total_priority"))
    return queue, per_unit
