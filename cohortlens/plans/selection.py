"""Selection frontier, sufficiency, gates, missing-data bounds and identified sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip, reason_precedence
from ..operators import ordered
from ..operators.aggregates import count_if, jaccard_stability
from ..operators.joins import combinations
from ..operators.ordered import By, join_on
from ..operators.sets import tagged_union
from ..operators.windows import best_of_others, kth_threshold, latest_by_key, order_rank, top_n_per_group
from ..session import cut_lineage
from .coverage import REASON_WEIGHT, lookup

# Normal quantiles of the 95 % and 90 % bounds.
Z95 = 1.96
Z90 = 1.6448536269514722
POOL = 30


def _bounds(df: DataFrame, z: float, low: str, high: str) -> DataFrame:
    out = df.withColumn("uncertainty", clip(F.coalesce("uncertainty", F.lit(0.25)), 0.025, 0.35))
    return out.withColumn(low, clip(F.round(F.col("overall") - z * F.col("uncertainty"), 12), 0.0, 1.0)).withColumn(
        high, clip(F.round(F.col("overall") + z * F.col("uncertainty"), 12), 0.0, 1.0)
    )


def selection_frontier(candidates: DataFrame) -> DataFrame:
    """95 % bounds; who may still reach the top 30 or the best place of the role; the
    top-35 and weak-evidence guardrails; the reason. ``candidates``: entity, role,
    minutes, overall, uncertainty, conservative_score, role_observations,
    role_stability; one row per entity."""
    df = cut_lineage(_bounds(candidates, Z95, "lower_95", "upper_95"))
    scored = df.where(F.col("overall").isNotNull())
    order = [By("conservative_score", True), By("minutes", True), "entity"]
    ranks = order_rank(scored.select("role", "entity", "conservative_score", "minutes"), ["role"], order, "role_rank")
    limits = kth_threshold(scored, ["role"], "lower_95", POOL, "entity")
    out = join_on(join_on(df, ranks.select("entity", "role_rank"), ["entity"], "left"), limits, ["role"], "left")
    upper = F.coalesce("upper_95", F.lit(1.0))
    weak = (
        F.col("overall").isNull()
        | (F.coalesce("role_observations", F.lit(0)) < 3)
        | (F.coalesce("role_stability", F.lit(0.0)) < 0.60)
    )
    out = out.select(
        *df.columns,
        "role_rank",
        F.col("kth_value").alias("top30_lower_threshold"),
        F.col("best_value").alias("best_lower_threshold"),
        F.coalesce(upper >= F.col("kth_value"), F.lit(False)).alias("plausible_top30"),
        F.coalesce(upper >= F.col("best_value"), F.lit(False)).alias("plausible_best"),
        F.coalesce(F.col("role_rank") <= 35, F.lit(False)).alias("guardrail_top35"),
        weak.alias("weak_evidence"),
    )
    inside = F.col("plausible_top30") | F.col("plausible_best") | F.col("guardrail_top35") | F.col("weak_evidence")
    reason = reason_precedence(
        [
            (F.col("weak_evidence"), "insufficient_evidence_guardrail"),
            (F.col("plausible_best"), "plausible_real_xi"),
            (F.col("plausible_top30"), "plausible_top30"),
        ],
        "top35_guardrail",
    )
    return out.withColumn("in_frontier", inside).withColumn("reason", reason)


def selection_sufficiency(candidates: DataFrame, spine: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """90 % screening: which sub-covered candidates could still change the covered pool
    of their role, with the reason, and the gate per role. ``candidates`` as in the
    frontier plus pass_current, pass_pre. ``spine`` (role) names the roles that must be there."""
    df = _bounds(candidates, Z90, "lo90", "hi90")
    covered = F.coalesce("pass_current", F.lit(False)) & F.coalesce("pass_pre", F.lit(False))
    stable = (
        (F.coalesce("role_stability", F.lit(0.0)) >= 0.60)
        & (F.coalesce("role_observations", F.lit(0)) >= 3)
        & F.col("overall").isNotNull()
    )
    df = cut_lineage(df.withColumn("covered", covered).withColumn("stable", stable))
    tail = [By("minutes", True), "entity"]
    df = ordered.row_index(df, ["role"], [By("conservative_score", True), *tail], "rank")
    df = cut_lineage(df)
    df = ordered.row_index(df, ["role"], [By("hi90", True), *tail], "urank")
    df = cut_lineage(df)
    sizes = df.groupBy("role").agg(
        F.count(F.lit(1)).alias("eligible"),
        count_if(F.col("stable")).alias("stable_n"),
        count_if(F.col("stable") & F.col("covered")).alias("covered_n"),
    )
    required = F.least(F.lit(POOL), F.col("stable_n"))
    best = top_n_per_group(df.where("stable AND covered"), ["role"], [F.col("lo90").desc(), F.col("entity")], POOL, rank="__k")
    kth = join_on(best.select("role", "lo90", "__k"), sizes, ["role"]).groupBy("role").agg(
        F.max(F.when(F.col("__k") == required, F.col("lo90"))).alias("__kth"), F.max("lo90").alias("__best")
    )
    roles = join_on(sizes, kth, ["role"], "left").select(
        "role",
        "eligible",
        "stable_n",
        "covered_n",
        required.alias("required"),
        ((F.col("covered_n") >= required) & (required > 0)).alias("enabled"),
        F.coalesce("__kth", F.lit(-1.0)).alias("top30_threshold"),
        F.coalesce("__best", F.lit(-1.0)).alias("best_threshold"),
    )
    # A short pool adds at most max(30, 5) challengers per role, so thirty rows suffice.
    under = top_n_per_group(df.where(~F.col("covered")), ["role"], [F.col("rank")], POOL, rank="__u").select("entity", "__u")
    rows = join_on(join_on(df, roles, ["role"]), under, ["entity"], "left")
    hi = F.coalesce("hi90", F.lit(1.0))
    open_ = ~F.col("covered")
    short = open_ & ~F.col("enabled") & (F.col("__u") <= F.greatest(F.col("required") - F.col("covered_n"), F.lit(5)))
    rules = [
        (open_ & ~F.col("stable") & ((F.col("urank") <= 15) | (F.col("rank") <= 15)), "high_ability_role_stabilization"),
        (open_ & F.col("stable") & (F.col("covered_n") > 0) & (hi >= F.col("best_threshold")), "upper90_can_enter_real_xi"),
        (open_ & F.col("stable") & F.col("enabled") & (hi >= F.col("top30_threshold")), "upper90_can_enter_top30"),
        (short, "covered_pool_shortage"),
        (open_ & F.col("stable") & (F.col("rank") <= F.col("required") + 5), "top35_guardrail"),
    ]
    reason = reason_precedence([(F.coalesce(t, F.lit(False)), n) for t, n in rules], "outside_decision_frontier")
    players = rows.withColumn("reason", reason).withColumn("needed", F.col("reason") != "outside_decision_frontier").drop("__u")
    open_n = players.groupBy("role").agg(count_if(F.col("needed")).alias("unresolved"))
    gates = join_on(roles, open_n, ["role"]).withColumn("passed", F.col("enabled") & (F.col("unresolved") == 0))
    if spine is not None:
        # A role of the spine without candidates stays in the table, and fails.
        gates = join_on(spine.select("role").distinct(), gates, ["role"], "left")
        zero = {c: 0 for c in ("eligible", "stable_n", "covered_n", "required", "unresolved")}
        gates = gates.fillna(zero).fillna(-1.0, ["top30_threshold", "best_threshold"]).fillna(False, ["enabled", "passed"])
    return players, gates


def overall_gate(gates: DataFrame) -> DataFrame:
    """One row: whether every role passes, how many do, and those that do not."""
    return gates.agg(
        F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"),
        F.count_if("passed").alias("roles_passed"),
        F.count(F.lit(1)).alias("roles"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("role")))), ",").alias("failing"),
    )


def candidate_gate(base: DataFrame, benchmark: DataFrame, ledger: DataFrame, n: int = POOL) -> tuple[DataFrame, DataFrame]:
    """Transparent score, the best ``n`` of each stable role united with the benchmark
    entities, and the coverage of that union per window. ``base``: entity, role,
    role_stability, score, minutes."""
    pool = base.where((F.col("role_stability") >= 0.60) & F.col("role").isNotNull())
    top = top_n_per_group(pool, ["role"], [F.col("score").desc(), F.col("minutes").desc(), F.col("entity")], n)
    union = tagged_union(benchmark, top, "entity")
    rows = ledger.join(union, "entity")
    out = rows.groupBy("window").agg(
        F.countDistinct("entity").alias("relevant"),
        F.countDistinct(F.when(F.col("passed"), F.col("entity"))).alias("passing"),
        F.avg(F.col("passed").cast("double")).alias("pass_rate"),
        F.sum("missing").alias("missing"),
        F.bool_and("passed").alias("gate"),
    )
    return union, out


def challenger_priority(players: DataFrame, gates: DataFrame) -> DataFrame:
    """Order of the unresolved challengers by what resolving them could change.
    ``players``: entity, role, reason, lo90, hi90, best_lower_threshold,
    top30_lower_threshold, missing; ``gates`` as from :func:`selection_sufficiency`."""
    need = F.greatest(F.col("required").cast("double"), F.lit(1.0))
    pressure = gates.select(
        "role",
        (F.greatest(need - F.col("covered_n"), F.lit(0.0)) / need + 0.25 * F.col("unresolved") / need).alias("role_pressure"),
    )
    rows = join_on(players, pressure, ["role"], "left")
    margin = lambda t: F.greatest(F.coalesce(clip(F.col("hi90") - F.col(t), -1.0, 1.0), F.lit(0.0)), F.lit(0.0))
    width = F.coalesce(F.greatest(F.col("hi90") - F.col("lo90"), F.lit(0.0)), F.lit(0.0))
    score = (
        lookup("reason", REASON_WEIGHT)
        + 2.0 * F.coalesce("role_pressure", F.lit(0.0))
        + 1.5 * width
        + 0.75 * margin("best_lower_threshold")
        + 0.35 * margin("top30_lower_threshold")
        + 0.15 * F.log1p(F.coalesce("missing", F.lit(0)).cast("double"))
    )
    return rows.withColumn("decision_priority", score)


SCENARIOS = ("observed", "empirical_low", "empirical_median", "empirical_high", "strict_low", "strict_high")


def missingness_scores(players: DataFrame) -> DataFrame:
    """Six scenario scores per player: (1 - w) score + w b with w the missing share of
    exposure and b the role's 5 %, 50 %, 95 % point over the stable covered pool (the
    whole role where that is empty), 0 or 1. One narrow row per scenario, made inside
    the row; nothing is joined but the role quantiles. ``players``: entity, role,
    minutes, overall, uncertainty, stable, covered, observed_minutes, missing_minutes."""
    base = cut_lineage(players)
    probs = {"q05": 0.05, "q50": 0.5, "q95": 0.95}
    good = ordered.quantiles(base.where("stable AND covered"), ["role"], ["overall"], probs)
    everyone = ordered.quantiles(base, ["role"], ["overall"], probs)
    for n in probs:
        everyone = everyone.withColumnRenamed(f"overall_{n}", f"__all_{n}")
    rows = join_on(join_on(base, good, ["role"], "left"), everyone, ["role"], "left")
    total = F.col("observed_minutes") + F.col("missing_minutes")
    w = F.coalesce(clip(F.when(total > 0, F.col("missing_minutes") / total), 0.0, 1.0), F.lit(0.0))
    q = lambda n: F.coalesce(f"overall_{n}", f"__all_{n}")
    mix = lambda b: (1 - w) * F.col("overall") + w * b
    scores = {
        "observed": F.col("overall"),
        "empirical_low": mix(q("q05")),
        "empirical_median": mix(q("q50")),
        "empirical_high": mix(q("q95")),
        "strict_low": mix(F.lit(0.0)),
        "strict_high": mix(F.lit(1.0)),
    }
    long = F.array(*[F.struct(F.lit(s).alias("scenario"), v.alias("score")) for s, v in scores.items()])
    out = rows.select("entity", "role", "minutes", "stable", "covered", "uncertainty", F.inline(long))
    return out.withColumn("conservative", clip(F.round(F.col("score") - F.col("uncertainty"), 9), 0.0, 1.0))


def scenario_members(scores: DataFrame, n: int = POOL) -> DataFrame:
    """Best ``n`` stable players per scenario and role; rank 1 is the winner."""
    order = [F.col("conservative").desc(), F.col("minutes").desc(), F.col("entity")]
    return top_n_per_group(scores.where("stable"), ["scenario", "role"], order, n, rank="scenario_rank")


def missingness_bounds(players: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members per scenario and role, stability of the winning set against the observed
    scenario, and identification per role: one winner in all scenarios, and a winner
    whose strict lower bound beats every rival's strict upper bound."""
    scores = cut_lineage(missingness_scores(players))
    members = cut_lineage(scenario_members(scores))
    winners = members.where(F.col("scenario_rank") == 1)
    stability = jaccard_stability(winners, "scenario", "entity", "observed")
    low = scores.where((F.col("scenario") == "strict_low") & F.col("stable")).select("role", "entity", "minutes", F.col("conservative").alias("lo"))
    high = scores.where((F.col("scenario") == "strict_high") & F.col("stable")).select("role", "entity", F.col("conservative").alias("hi"))
    pairs = best_of_others(low.join(high, ["role", "entity"]), ["role"], "entity", "hi", "lo")
    top = latest_by_key(pairs, ["role"], [F.col("lo").desc(), F.col("minutes").desc(), F.col("entity")])
    by_role = winners.groupBy("role").agg(F.countDistinct("entity").alias("scenario_winners"))
    roles = join_on(by_role, top.select("role", F.col("entity").alias("strict_candidate"), F.col("identified").alias("strict_identified")), ["role"], "left")
    return members, stability, roles.withColumn(
        "point_identified", (F.col("scenario_winners") == 1) & F.coalesce("strict_identified", F.lit(False))
    )


def identified_set(winners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roles with a single winner over all scenarios are the invariant core, the others
    ambiguous; and every combination of one candidate per role."""
    candidates = cut_lineage(winners.select("role", "entity").distinct())
    per = candidates.groupBy("role").agg(F.count(F.lit(1)).alias("candidates"))
    core = join_on(candidates, per, ["role"]).withColumn("invariant", F.col("candidates") == 1)
    return core, combinations(winners.sparkSession, candidates, "role", "entity")
