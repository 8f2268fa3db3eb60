"""Aggregations. Every one is a ``groupBy().agg()`` with map-side partial results;
quantiles and trimmed means come from :mod:`.ordered`."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bucketise, clip, finite_or_zero, per_exposure, safe_ratio
from . import ordered
from .ordered import attach_totals, join_on


def zsum(col: Column | str) -> Column:
    """Sum that is 0, not null, when nothing is present."""
    return F.coalesce(F.sum(col), F.lit(0.0))


def count_if(test: Column) -> Column:
    return F.count_if(test)


# --- entity features -----------------------------------------------------------------


def entity_features(
    rows: DataFrame,
    keys: Sequence[str],
    counters: Sequence[str],
    rates: Sequence[str],
    ratios: Mapping[str, tuple[str, str, float]],
    exposure: str = "minutes",
    rating: str | None = None,
    rating_key: str | None = None,
    cards: tuple[str, str] | None = None,
) -> DataFrame:
    """Counter sums per entity, per-90 rates, guarded ratios, and the mean rating over
    rated rows, which is by ``rating_key`` alone."""
    aggs = [zsum(x).alias(x) for x in [exposure, *counters]]
    if rating:
        rated = F.when(F.col(rating) > 0, F.col(rating))
        aggs += [F.sum(rated).alias("__rs"), F.count(rated).alias("__rn")]
    out = rows.groupBy(*keys).agg(*aggs)
    if rating:
        # The rows are read once: an entity has few key rows left after the aggregation.
        w = Window.partitionBy(rating_key)
        mean = F.sum("__rs").over(w) / F.nullif(F.sum("__rn").over(w), F.lit(0))
        out = out.withColumn(f"{rating}_mean", mean).drop("__rs", "__rn")
    cols = [per_exposure(r, exposure).alias(f"{r}_p90") for r in rates]
    if cards:
        weighted = F.col(cards[0]) + 2 * F.col(cards[1])
        cols.append(per_exposure(weighted, exposure).alias("cards_p90"))
    for name, (num, den, scale) in ratios.items():
        cols.append(safe_ratio(F.lit(scale) * F.col(num), den, zero=True).alias(name))
    out = out.select("*", *cols)
    fill = [f"{rating}_mean"] if rating else []
    return out.select(*[finite_or_zero(x).alias(x) if x in fill else F.col(x) for x in out.columns])


def entity_features_weighted(
    rows: DataFrame, keys: Sequence[str], accuracy: str, exposure: str = "minutes", counters: Sequence[str] = ()
) -> DataFrame:
    """Variant whose accuracy is the exposure-weighted mean of per-row accuracies."""
    w = F.col(exposure)
    return rows.groupBy(*keys).agg(
        zsum(exposure).alias(exposure),
        *[zsum(x).alias(x) for x in counters],
        safe_ratio(F.sum(F.col(accuracy) * w), F.sum(w), zero=True).alias(f"{accuracy}_weighted"),
    )


def window_totals(rows: DataFrame, keys: Sequence[str], unit: str, sums: Sequence[str], starts: Column, ratio=None) -> DataFrame:
    """Per entity and window: distinct units, starts, sums, completion rate."""
    aggs = [F.countDistinct(unit).alias("units"), count_if(starts).alias("starts")]
    aggs += [zsum(x).alias(x) for x in sums]
    out = rows.groupBy(*keys).agg(*aggs)
    if ratio:
        name, num, den = ratio
        out = out.withColumn(name, safe_ratio(num, den))
    return out


def mode_and_stability(rows: DataFrame, keys: Sequence[str], value: str, prefix: str = "") -> DataFrame:
    """Smallest most frequent value and its share; nulls ignored; a group without
    values keeps a null mode and share 0. Counted per (group, value) first."""
    counts = rows.groupBy(*keys, value).agg(F.count(value).alias("__n"))
    ordered_best = F.min(F.when(F.col("__n") > 0, F.struct((-F.col("__n")).alias("n"), F.col(value).alias("v"))))
    return counts.groupBy(*keys).agg(ordered_best.alias("__b"), F.sum("__n").alias("__t")).select(
        *keys,
        F.col("__b.v").alias(f"{prefix}mode"),
        F.coalesce(-F.col("__b.n") / F.col("__t"), F.lit(0.0)).alias(f"{prefix}stability"),
        F.col("__t").alias(f"{prefix}observations"),
    )


def conditional_distinct_rates(rows: DataFrame, group: str, entity: str, flags: Mapping[str, Column], sums: Sequence[str] = ()) -> DataFrame:
    """Distinct entities and distinct entities under each flag, with rates; the null
    group is kept."""
    aggs = [F.countDistinct(entity).alias("entities")]
    aggs += [F.countDistinct(F.when(test, F.col(entity))).alias(n) for n, test in flags.items()]
    aggs += [zsum(x).alias(x) for x in sums]
    out = rows.groupBy(group).agg(*aggs)
    return out.select("*", *[safe_ratio(n, "entities", zero=True).alias(f"{n}_rate") for n in flags])


def weighted_share(rows: DataFrame, sets: Sequence[Sequence[str]], weight: str, usable: Column) -> DataFrame:
    """Sum of the weight where usable over the whole weight, for several groupings in
    one pass (grouping sets); ``level`` names the grouping."""
    dims = list(dict.fromkeys(x for s in sets for x in s))
    grouped = rows.groupingSets([[F.col(x) for x in s] for s in sets], *dims).agg(
        zsum(weight).alias("weight"),
        zsum(F.when(usable, F.col(weight))).alias("usable_weight"),
        *[F.grouping(x).alias(f"__g_{x}") for x in dims],
    )
    parts = [F.when(F.col(f"__g_{x}") == 0, x) for x in dims]
    level = F.when(F.concat_ws("+", *parts) == "", "total").otherwise(F.concat_ws("+", *parts))
    return grouped.select(
        level.alias("level"), *dims, "weight", "usable_weight", safe_ratio("usable_weight", "weight", zero=True).alias("share")
    )


# --- distributions -------------------------------------------------------------------


def distribution_summary(rows: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """n, coverage, mean, sd (n-1), p05/25/50/75/95, min, max per metric, long form."""
    long = rows.unpivot(list(keys), list(metrics), "metric", "value")
    probs = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    groups = [*keys, "metric"]
    base = long.groupBy(*groups).agg(
        F.count("value").alias("n"),
        F.avg(F.col("value").isNotNull().cast("double")).alias("coverage"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    q = ordered.quantiles(long, groups, ["value"], probs)
    out = join_on(base, q, groups, "left")
    for name in probs:
        out = out.withColumnRenamed(f"value_{name}", name)
    return out


def group_quantiles(rows: DataFrame, keys: Sequence[str], value: str, passed: Column) -> DataFrame:
    """Counts, pass rate, median and p10 per group."""
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entities"),
        count_if(passed).alias("passing"),
        F.avg(passed.cast("double")).alias("pass_rate"),
    )
    q = ordered.quantiles(rows, keys, [value], {"median": 0.5, "p10": 0.1})
    return join_on(base, q, keys, "left")


def nonnull_profile(rows: DataFrame, columns: Sequence[str], populations: Mapping[str, Column]) -> DataFrame:
    """Non-null rate per column and population, one scan; long form."""
    tags = F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in populations.items()]))
    tagged = rows.select(F.explode(tags).alias("population"), *columns)
    wide = tagged.groupBy("population").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(F.col(x).isNotNull().cast("double")).alias(x) for x in columns],
    )
    return wide.unpivot(["population", "rows"], list(columns), "column", "nonnull_rate")


def endpoint_rates(rows: DataFrame, keys: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """Sampled units and availability rate per endpoint, per key."""
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sampled"), *[count_if(t).alias(n) for n, t in flags.items()]
    )
    return out.select("*", *[(F.col(n) / F.col("sampled")).alias(f"{n}_rate") for n in flags])


def rate_classes(rates: DataFrame, column: str) -> DataFrame:
    """How many keys have rate zero, partial, full."""
    r = F.col(column)
    return rates.agg(
        count_if(r == 0).alias("zero"), count_if((r > 0) & (r < 1)).alias("partial"), count_if(r == 1).alias("full")
    )


def value_distribution(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Count and share per value, overall or inside a group."""
    counts = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    out = attach_totals(counts, group, [F.sum("n").alias("__t")])
    return out.withColumn("share", F.col("n") / F.col("__t")).drop("__t")


def convergence_checkpoints(
    rows: DataFrame, keys: Sequence[str], order: ordered.Order, points: Sequence[int], aggs: Mapping[str, Column]
) -> DataFrame:
    """Aggregates over the first n rows for each n in ``points``. A row within the
    smallest point counts for all larger ones."""
    placed = ordered.row_index(rows, keys, order, "__i").where(F.col("__i") <= max(points))
    hits = F.filter(F.array(*[F.lit(p) for p in points]), lambda p: p >= F.col("__i"))
    return (
        placed.withColumn("checkpoint", F.explode(hits))
        .groupBy(*keys, "checkpoint")
        .agg(F.count(F.lit(1)).alias("n"), *[a.alias(n) for n, a in aggs.items()])
    )


def hierarchical_summary(
    rows: DataFrame, scenario: str, combination: Sequence[str], world: str, value: str
) -> tuple[DataFrame, DataFrame]:
    """rows -> world means -> (mean, q025, q975) per combination -> scenario envelope
    with a robust direction when all combinations agree in sign."""
    worlds = rows.groupBy(scenario, *combination, world).agg(F.avg(value).alias("world_mean"))
    keys = [scenario, *combination]
    base = worlds.groupBy(*keys).agg(F.avg("world_mean").alias("mean"), F.count(F.lit(1)).alias("worlds"))
    q = ordered.quantiles(worlds, keys, ["world_mean"], {"q025": 0.025, "q975": 0.975})
    combos = join_on(base, q, keys).withColumnRenamed("world_mean_q025", "q025").withColumnRenamed(
        "world_mean_q975", "q975"
    )
    envelope = combos.groupBy(scenario).agg(
        F.count(F.lit(1)).alias("combinations"),
        F.min("mean").alias("mean_low"),
        F.max("mean").alias("mean_high"),
        F.min("q025").alias("low"),
        F.max("q975").alias("high"),
        F.when(F.bool_and(F.col("mean") > 0), "positive")
        .when(F.bool_and(F.col("mean") < 0), "negative")
        .otherwise("undetermined")
        .alias("direction"),
    )
    return combos, envelope


def interval_summary(rows: DataFrame, columns: Sequence[str], a: str, b: str) -> DataFrame:
    """Mean, median and 2.5/10/90/97.5 points per column, and P(a > b)."""
    probs = {"p025": 0.025, "p10": 0.10, "p50": 0.5, "p90": 0.90, "p975": 0.975}
    long = rows.unpivot([], list(columns), "metric", "value")
    base = long.groupBy("metric").agg(F.avg("value").alias("mean"))
    q = ordered.quantiles(long, ["metric"], ["value"], probs)
    win = rows.agg(F.avg((F.col(a) > F.col(b)).cast("double")).alias("p_a_over_b"))
    out = join_on(join_on(base, q, ["metric"]), win, [])
    for n in probs:
        out = out.withColumnRenamed(f"value_{n}", n)
    return out


def weighted_group_mean(
    rows: DataFrame, group: str, entity: str, score: str, k: int, values: Sequence[str], exposure: str = "minutes"
) -> DataFrame:
    """Top-k rows per group by score, means weighted with sqrt(max(exposure, 90)), and
    the z-score of the group mean of ``score`` over the groups (population sd)."""
    from .windows import top_n_per_group

    top = top_n_per_group(rows, [group], [F.col(score).desc(), F.col(entity)], k)
    w = F.sqrt(F.greatest(F.col(exposure), F.lit(90.0)))
    means = top.groupBy(group).agg(
        F.count(F.lit(1)).alias("members"), *[(F.sum(w * F.col(v)) / F.sum(w)).alias(v) for v in values]
    )
    over = means.agg(F.avg(score).alias("__mu"), F.greatest(F.stddev_pop(score), F.lit(1e-9)).alias("__sd"))
    out = join_on(means, over, [])
    return out.withColumn("z", (F.col(score) - F.col("__mu")) / F.col("__sd")).drop("__mu", "__sd")


def side_unit_features(rows: DataFrame, keys: Sequence[str], exposure: str = "minutes", rating: str = "rating") -> DataFrame:
    """Exposure-weighted rating and success ratios per (unit, side) with defaults."""
    w = F.greatest(F.coalesce(F.col(exposure), F.lit(0.0)), F.lit(0.0))
    g = rows.groupBy(*keys).agg(
        zsum(F.coalesce(F.col(rating), F.lit(0.0)) * w).alias("__rn"),
        zsum(w).alias("__w"),
        zsum("shots").alias("shots"),
        *[zsum(x).alias(f"__{x}") for x in ("passes", "passes_accurate", "duels", "duels_won")],
    )
    return g.select(
        *keys,
        F.coalesce(safe_ratio("__rn", "__w"), F.lit(6.5)).alias("rating"),
        "shots",
        F.coalesce(safe_ratio("__passes_accurate", "__passes"), F.lit(0.75)).alias("pass_accuracy"),
        F.coalesce(safe_ratio("__duels_won", "__duels"), F.lit(0.5)).alias("duel_success"),
    )


def spatial_side_features(events: DataFrame, keys: Sequence[str], info: DataFrame | None = None, info_keys: Sequence[str] = ()) -> DataFrame:
    """Passes, completion, shots, expected goals, pressures, carries, progressive
    actions (forward by 15 or more) and mean visible counts per (unit, side)."""
    is_pass = F.col("type") == "Pass"
    forward = F.col("end_x") - F.col("x") >= 15
    progressive = F.col("type").isin("Pass", "Carry") & forward
    out = events.groupBy(*keys).agg(
        count_if(is_pass).alias("passes"),
        count_if(is_pass & F.col("outcome").isNull()).alias("completed_passes"),
        count_if(F.col("type") == "Shot").alias("shots"),
        zsum("xg").alias("xg"),
        count_if(F.col("type") == "Pressure").alias("pressures"),
        count_if(F.col("type") == "Carry").alias("carries"),
        count_if(progressive).alias("progressive_actions"),
        count_if(F.coalesce(F.col("under_pressure"), F.lit(False))).alias("under_pressure"),
        F.count("visible").alias("frames"),
        F.avg("visible").alias("mean_visible"),
    )
    out = out.withColumn("completion", safe_ratio("completed_passes", "passes"))
    return join_on(out, info, info_keys, "left") if info is not None else out


# --- agreement -----------------------------------------------------------------------


def cohen_kappa(rows: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Observed and expected agreement and kappa; expected 1 gives kappa 1. Works on
    the (a, b) counts, whose number is bounded by the labels."""
    cells = rows.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(
        F.struct(F.lit("a").alias("side"), F.col(a).cast("string").alias("label")),
        F.struct(F.lit("b").alias("side"), F.col(b).cast("string").alias("label")),
    )
    marg = (
        cells.withColumn("s", F.explode(sides))
        .groupBy(*keys, F.col("s.label").alias("label"))
        .agg(
            F.sum(F.when(F.col("s.side") == "a", F.col("n")).otherwise(0)).alias("na"),
            F.sum(F.when(F.col("s.side") == "b", F.col("n")).otherwise(0)).alias("nb"),
        )
        .groupBy(*keys)
        .agg((F.sum(F.col("na") * F.col("nb"))).alias("cross"))
    )
    tot = cells.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col(a).eqNullSafe(F.col(b)), F.col("n")).otherwise(0)).alias("same"),
    )
    out = join_on(tot, marg, list(keys))
    po = F.col("same") / F.col("n")
    pe = F.col("cross") / (F.col("n") * F.col("n"))
    return out.select(
        *keys,
        "n",
        po.alias("observed"),
        pe.alias("expected"),
        F.when(pe == 1, 1.0).otherwise((po - pe) / F.when(pe != 1, 1 - pe)).alias("kappa"),
    )


def confusion_matrix(rows: DataFrame, a: str, b: str, labels: Sequence, spine: DataFrame) -> DataFrame:
    """Cross-table in a fixed label order, zero filled; ``spine`` holds the labels."""
    counts = rows.groupBy(a).pivot(b, list(labels)).agg(F.count(F.lit(1)))
    names = [str(x) for x in labels]
    named = counts.select(F.col(a).alias("label"), *[F.col(f"`{n}`").alias(f"pred_{n}") for n in names])
    out = spine.join(named, "label", "left")
    return out.select("label", *[F.coalesce(F.col(f"pred_{n}"), F.lit(0)).alias(f"pred_{n}") for n in names])


def jaccard_stability(members: DataFrame, scenario: str, member: str, baseline: str, keys: Sequence[str] = ()) -> DataFrame:
    """Jaccard index and symmetric difference of every scenario's set to the baseline.
    Grouped by member first: a member has one row per scenario, never a pair per pair
    of members."""
    base = members.where(F.col(scenario) == baseline).select(*keys, member).distinct()
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("base_n"))
    sets = members.select(*keys, scenario, member).distinct()
    marked = join_on(sets, base.withColumn("__in", F.lit(1)), [*keys, member], "left")
    per = marked.groupBy(*keys, scenario).agg(
        F.count(F.lit(1)).alias("set_n"), F.count("__in").alias("both_n")
    )
    out = join_on(per, sizes, list(keys), "left" if keys else "inner")
    base_n = F.coalesce(F.col("base_n"), F.lit(0))
    union = F.col("set_n") + base_n - F.col("both_n")
    return out.select(
        *keys,
        scenario,
        "set_n",
        "both_n",
        F.when(union == 0, 1.0).otherwise(F.col("both_n") / F.when(union > 0, union)).alias("jaccard"),
        (union - F.col("both_n")).alias("symmetric_difference"),
    )


def distribution_string(rows: DataFrame, keys: Sequence[str], value: str, separator: str = " | ") -> DataFrame:
    """Text such as ``A:12 | B:3`` by falling count, then label. Collects counted labels
    (one per distinct label), never rows."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))))
    text = F.transform(pairs, lambda p: F.concat(p["v"].cast("string"), F.lit(":"), (-p["m"]).cast("string")))
    return counts.groupBy(*keys).agg(F.array_join(text, separator).alias("distribution"))


def pivot_windows(rows: DataFrame, key: str, window: str, windows: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long (key, window) rows to ``<column>_<window>`` columns."""
    aggs = [
        F.first(F.when(F.col(window) == w, F.col(x)), ignorenulls=True).alias(f"{x}_{w}") for w in windows for x in columns
    ]
    return rows.groupBy(key).agg(*aggs)


# --- forecasts and effects -----------------------------------------------------------


def calibration_bins(rows: DataFrame, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """n, mean confidence and accuracy per model and bin of the largest probability."""
    conf = F.greatest("p_home", "p_draw", "p_away")
    binned = rows.withColumn("confidence", conf).withColumn("bin", bucketise("confidence", edges, labels, include_lowest=True))
    return binned.where(F.col("bin").isNotNull()).groupBy("model", "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg(F.col("accuracy").cast("double")).alias("observed_accuracy"),
    )


def model_scores(rows: DataFrame, naive: str) -> DataFrame:
    """Mean scores per model and the log-loss skill against the naive model."""
    means = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("matches"),
        F.avg("brier").alias("brier_score"),
        F.avg("log_loss").alias("log_loss"),
        F.avg("rps").alias("ranked_probability_score"),
        F.avg(F.col("accuracy").cast("double")).alias("top1_accuracy"),
    )
    base = rows.where(F.col("model") == naive).agg(F.avg("log_loss").alias("__n"))
    return join_on(means, base, []).withColumn("log_loss_skill_vs_naive", 1 - F.col("log_loss") / F.col("__n")).drop("__n")


def factor_effects(rows: DataFrame, factors: Mapping[str, tuple[str, str]], metrics: Sequence[str]) -> DataFrame:
    """Marginal mean of the alternative level minus that of the reference level, per
    factor and metric."""
    aggs = []
    for f, (ref, alt) in factors.items():
        for m in metrics:
            aggs.append(
                (F.avg(F.when(F.col(f) == alt, F.col(m))) - F.avg(F.when(F.col(f) == ref, F.col(m)))).alias(f"{f}|{m}")
            )
    wide = rows.agg(*aggs)
    long = wide.unpivot([], [f"`{x}`" for x in wide.columns], "__k", "effect")
    part = F.split("__k", r"\|")
    return long.select(part[0].alias("factor"), part[1].alias("metric"), "effect")


def profile_gap(real: DataFrame, synthetic: DataFrame, role: str, dims: Sequence[str]) -> DataFrame:
    """Mean of the real members minus the synthetic value, per role and dimension."""
    left = real.groupBy(role).agg(*[F.avg(d).alias(d) for d in dims]).unpivot([role], list(dims), "dimension", "real_mean")
    right = synthetic.select(role, *dims).unpivot([role], list(dims), "dimension", "synthetic")
    return join_on(left, right, [role, "dimension"]).withColumn("gap", F.col("real_mean") - F.col("synthetic"))


def canonicalise_ids(rows: DataFrame, key: str, sums: Sequence[str], name: str, exposure: str) -> DataFrame:
    """One row per id: counters summed, the name of the row with the largest exposure
    (ties: smallest name)."""
    best = F.min(F.struct((-F.col(exposure)).alias("e"), F.col(name).alias("v")))["v"]
    return rows.groupBy(key).agg(best.alias(name), *[zsum(x).alias(x) for x in sums])


def unit_value_queue(rows: DataFrame, unit: str, entity: str, priority: str, weights: tuple[float, float, float]) -> DataFrame:
    """Per unit: distinct entities, largest and total priority, information value."""
    per = rows.groupBy(unit).agg(
        F.countDistinct(entity).alias("entities"),
        F.max(priority).alias("max_priority"),
        F.sum(priority).alias("total_priority"),
    )
    a, b, d = weights
    return per.withColumn(
        "information_value", a * F.col("total_priority") + b * F.col("max_priority") + d * F.log1p("entities")
    )


def progress_counts(progress: DataFrame, status: str, unit: str, targets: DataFrame) -> DataFrame:
    """Units per status and how many of the target units each status holds."""
    t = targets.select(unit).distinct().withColumn("__t", F.lit(1))
    marked = join_on(progress, t, [unit], "left")
    return marked.groupBy(status).agg(
        F.count(F.lit(1)).alias("units"), F.count("__t").alias("target_units")
    )


# --- gates and checks ----------------------------------------------------------------


def provider_support_summary(rows: DataFrame, keys: Sequence[str], unit: str, entity: str, exposure: str) -> DataFrame:
    """Per combination of keys (null is one): rows, distinct units and entities, exposure."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(unit).alias("units"), F.countDistinct(entity).alias("entities"), F.sum(exposure).alias("minutes")
    )


def gate_table(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One metrics row against thresholds(metric, kind, threshold): kind ``min`` asks
    value >= threshold, ``max_abs`` asks abs(value) <= threshold."""
    long = metrics.unpivot([], metrics.columns, "metric", "value")
    joined = long.join(thresholds, "metric")
    ok = F.when(F.col("kind") == "min", F.col("value") >= F.col("threshold")).otherwise(
        F.abs("value") <= F.col("threshold")
    )
    return joined.withColumn("passed", F.coalesce(ok, F.lit(False)))


def gate_decision(gates: DataFrame) -> DataFrame:
    """All gates passed, and the blocking ones by name (one entry per metric)."""
    return gates.agg(
        F.bool_and("passed").alias("passed"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("metric")))), ",").alias("blocking"),
    )


def representation_choice(rows: DataFrame, keys: Sequence[str], source: str, coverage: str, order: Mapping[str, int], minimum: float = 0.8) -> DataFrame:
    """First source in the preference order whose coverage reaches the minimum."""
    pref = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
    ok = F.col(coverage) >= minimum
    return rows.groupBy(*keys).agg(
        F.min(F.when(ok, F.struct(F.try_element_at(pref, F.col(source)).alias("p"), F.col(source).alias("s"))))["s"].alias("chosen"),
        count_if(ok).alias("qualifying"),
    )


def consistency_flags(rows: DataFrame, rules: Mapping[str, Column], key: str) -> DataFrame:
    """Rows carrying at least one contradictory flag or a duplicated key."""
    flagged = rows.select("*", *[t.alias(n) for n, t in rules.items()])
    dup = rows.groupBy(key).agg((F.count(F.lit(1)) > 1).alias("duplicate_key"))
    out = join_on(flagged, dup, [key], "left")
    names = [*rules, "duplicate_key"]
    total = sum((F.coalesce(F.col(n), F.lit(False)).cast("int") for n in names), F.lit(0))
    return out.withColumn("anomalies", total)


def competition_inventory(units: DataFrame, keys: Sequence[str], windows: Sequence[str]) -> DataFrame:
    return units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("units"), *[count_if(F.col(w)).alias(f"units_{w}") for w in windows]
    )


def spine_counts(rows: DataFrame, role: str, entity: str, spine: DataFrame, name: str = "entities") -> DataFrame:
    """Distinct entities per role on a fixed role list, zero filled."""
    counts = rows.groupBy(role).agg(F.countDistinct(entity).alias(name))
    return join_on(spine, counts, [role], "left").select(role, F.coalesce(name, F.lit(0)).alias(name))


def transition_counts(rows: DataFrame, window: str, entity: str, before: Column, after: Column) -> DataFrame:
    up, down = ~before & after, before & ~after
    return rows.groupBy(window).agg(
        count_if(up).alias("false_to_true"),
        count_if(down).alias("true_to_false"),
        F.countDistinct(F.when(up | down, F.col(entity))).alias("entities_changed"),
    )


def eligibility_change(candidates: DataFrame, exact: DataFrame, key: str, minimum: float) -> DataFrame:
    """Eligibility by the reported and by the exact exposure, and who changed."""
    joined = join_on(candidates, exact, [key], "left")
    m = F.coalesce("exact_minutes", F.lit(0.0))
    old = F.coalesce("reported_minutes", F.lit(0.0)) >= minimum
    new = m >= minimum
    return joined.select(
        *candidates.columns,
        m.alias("exact_minutes"),
        old.alias("old_eligible"),
        new.alias("exact_eligible"),
        (old & ~new).alias("changed_to_ineligible"),
    )


def side_record(sides: DataFrame, side: str) -> DataFrame:
    """Matches, goals for and against, clean sheets per side."""
    return sides.groupBy(side).agg(
        F.count(F.lit(1)).alias("matches"),
        F.sum("goals_for").alias("goals_for"),
        F.sum("goals_against").alias("goals_against"),
        count_if(F.col("goals_against") == 0).alias("clean_sheets"),
    )


def metric_error_table(observed: DataFrame, candidate: DataFrame) -> DataFrame:
    """Two one-row frames compared metric by metric."""
    a = observed.unpivot([], observed.columns, "metric", "observed")
    b = candidate.unpivot([], candidate.columns, "metric", "candidate")
    return a.join(b, "metric").select(
        "metric",
        "observed",
        "candidate",
        F.abs(F.col("candidate") - F.col("observed")).alias("abs_error"),
        F.when(F.col("observed") != 0, F.col("candidate") / F.col("observed")).alias("ratio"),
    )


def calibration_targets(units: DataFrame, shots: DataFrame) -> DataFrame:
    """Outcome targets of finished units: mean and sd of goals, 0-0 / H / D / A rates,
    captured share of shots, adjustment clip(exact/captured, 1, 1.4). ``shots`` holds
    (exact, captured) per unit."""
    g = F.col("home_goals") + F.col("away_goals")
    a = units.agg(
        F.count(F.lit(1)).alias("units"),
        F.avg(g.cast("double")).alias("mean_goals"),
        F.stddev_samp(g.cast("double")).alias("sd_goals"),
        F.avg((g == 0).cast("double")).alias("rate_nil_nil"),
        F.avg((F.col("home_goals") > F.col("away_goals")).cast("double")).alias("rate_home"),
        F.avg((F.col("home_goals") == F.col("away_goals")).cast("double")).alias("rate_draw"),
        F.avg((F.col("home_goals") < F.col("away_goals")).cast("double")).alias("rate_away"),
    )
    b = shots.agg(zsum("exact").alias("exact"), zsum("captured").alias("captured"), F.avg("captured").alias("mean_captured"))
    adj = F.coalesce(clip(safe_ratio("exact", "captured"), 1.0, 1.4), F.lit(1.0))
    return join_on(a, b, []).select(
        *a.columns,
        safe_ratio("captured", "exact").alias("capture_rate"),
        adj.alias("adjustment"),
        (F.col("mean_captured") * adj).alias("adjusted_shots"),
    )


def entity_universe(roster: DataFrame, lines: DataFrame, entity: str, season: str, seasons: Sequence[int], exposure: str) -> DataFrame:
    """Every roster member with presence per season, line count and total exposure."""
    per = lines.groupBy(entity).agg(
        *[F.bool_or(F.col(season) == s).alias(f"in_{s}") for s in seasons],
        F.count(F.lit(1)).alias("lines"),
        F.sum(exposure).alias("total_exposure"),
    )
    out = join_on(roster, per, [entity], "left")
    return out.select(
        *roster.columns,
        *[F.coalesce(f"in_{s}", F.lit(False)).alias(f"in_{s}") for s in seasons],
        F.coalesce("lines", F.lit(0)).alias("lines"),
        F.coalesce("total_exposure", F.lit(0.0)).alias("total_exposure"),
    )
