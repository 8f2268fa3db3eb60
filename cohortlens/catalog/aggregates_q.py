"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import ordered
from ..operators.filters import window_membership
from ..operators.resample import bootstrap_ci, bootstrap_worlds, scatter_sql
from ..operators.sets import two_side_rows
from ..operators.tables import literal_table
from .base import CTE, CTE_DEPS, query
from .windows_q import features, ranked

WINDOWS = {"current": "in_current", "pre": "in_pre"}
FLAGS = ("A", "N", "R")


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query(
    "A1_entity_features",
    """SELECT entity, entity_name, cohort, minutes, shots, goals, round(rating_mean,6) AS rating_mean, round(shots_p90,6) AS shots_p90,
  round(cards_p90,6) AS cards_p90, round(pass_accuracy,6) AS pass_accuracy, round(duel_win_rate,6) AS duel_win_rate FROM feat""",
    ("feat",),
)
def _(t):
    return features(t).select(
        "entity", "entity_name", "cohort", "minutes", "shots", "goals",
        *r6("rating_mean", "shots_p90", "cards_p90", "pass_accuracy", "duel_win_rate"),
    )


@query(
    "A2_entity_features_weighted",
    """SELECT entity, cohort, sum(minutes) AS minutes, sum(shots) AS shots,
  round(sum(rating*minutes)/sum(minutes),6) AS rating_weighted FROM eu GROUP BY ALL""",
    ("eu",),
)
def _(t):
    out = A.entity_features_weighted(t.entity_units(), ["entity", "cohort"], "rating", counters=["shots"])
    return out.select("entity", "cohort", "minutes", "shots", *r6("rating_weighted"))


def dated_details(t):
    """Detail rows with the window flags of their unit."""
    u = t.units().select("unit", "in_current", "in_pre", "official", "status", "season", "league")
    return t.details().join(u, "unit")


CTE["dd"] = "SELECT det.*, in_current, in_pre, official, status, season, league FROM det JOIN u USING (unit)"
CTE_DEPS["dd"] = ("det", "u")
CTE["ddw"] = """
SELECT *, 'current' AS window FROM dd WHERE in_current UNION ALL SELECT *, 'pre' AS window FROM dd WHERE in_pre"""
CTE_DEPS["ddw"] = ("dd",)


@query(
    "A3_window_totals",
    """SELECT entity, "window", count(DISTINCT unit) AS units, count(*) FILTER (source='startXI') AS starts, sum(minutes) AS minutes,
  sum(CAST(line AS DOUBLE)) AS line, round(sum(CAST(line AS DOUBLE))/sum(minutes),6) AS line_rate FROM ddw GROUP BY ALL""",
    ("ddw",),
)
def _(t):
    rows = window_membership(dated_details(t), WINDOWS).withColumn("line", F.col("line").cast("double"))
    out = A.window_totals(
        rows, ["entity", "window"], "unit", ["minutes", "line"], F.col("source") == "startXI", ("line_rate", "line", "minutes")
    )
    return out.select("entity", "window", "units", "starts", "minutes", "line", *r6("line_rate"))


@query(
    "A4_mode_and_stability",
    """SELECT user_id, mode, round(n*1e0/t,6) AS stability, CAST(t AS BIGINT) AS observations FROM (
  SELECT user_id, event_type AS mode, n, sum(n) OVER (PARTITION BY user_id) AS t,
    row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn
  FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE rn=1""",
)
def _(t):
    out = A.mode_and_stability(t.events, ["user_id"], "event_type")
    return out.select("user_id", "mode", F.round("stability", 6).alias("stability"), "observations")


@query(
    "A5_conditional_distinct_rates",
    """SELECT grp, count(DISTINCT c_custkey) AS entities, count(DISTINCT CASE WHEN c_acctbal>0 THEN c_custkey END) AS positive,
  count(DISTINCT CASE WHEN c_acctbal>5000 THEN c_custkey END) AS rich,
  round(count(DISTINCT CASE WHEN c_acctbal>0 THEN c_custkey END)*1e0/count(DISTINCT c_custkey),6) AS positive_rate,
  round(count(DISTINCT CASE WHEN c_acctbal>5000 THEN c_custkey END)*1e0/count(DISTINCT c_custkey),6) AS rich_rate
FROM (SELECT *, nullif(c_mktsegment,'MACHINERY') AS grp FROM customer) GROUP BY grp""",
)
def _(t):
    rows = t.customer.withColumn("grp", F.nullif("c_mktsegment", F.lit("MACHINERY")))
    out = A.conditional_distinct_rates(
        rows, "grp", "c_custkey", {"positive": F.col("c_acctbal") > 0, "rich": F.col("c_acctbal") > 5000}
    )
    return out.select("grp", "entities", "positive", "rich", *r6("positive_rate", "rich_rate"))


@query(
    "A6_weighted_share",
    """SELECT CASE WHEN grouping(side)=0 THEN 'side' WHEN grouping(cohort)=0 THEN 'cohort' ELSE 'total' END AS level, side, cohort,
  sum(minutes) AS weight, coalesce(sum(CASE WHEN rating>0 THEN minutes END),0e0) AS usable_weight,
  round(coalesce(sum(CASE WHEN rating>0 THEN minutes END),0e0)/sum(minutes),6) AS share
FROM eu GROUP BY GROUPING SETS ((side),(cohort),())""",
    ("eu",),
)
def _(t):
    out = A.weighted_share(t.entity_units(), [["side"], ["cohort"], []], "minutes", F.col("rating") > 0)
    return out.select("level", "side", "cohort", "weight", "usable_weight", *r6("share"))


@query(
    "A9_exit_events",
    """SELECT user_id, day, min(least(greatest(value,0e0),130e0)) AS exit_minute
FROM (SELECT user_id, CAST(ts AS DATE) AS day, value, event_type FROM events) WHERE event_type IN ('error','signup') GROUP BY ALL""",
)
def _(t):
    from ..plans.coverage import exit_events

    ev = t.events.select(
        "user_id",
        F.to_date("ts").alias("day"),
        F.when(F.col("event_type") == "error", "subst").when(F.col("event_type") == "signup", "card").alias("event_type"),
        F.lit("red card").alias("detail"),
        F.col("value").alias("elapsed"),
    )
    return exit_events(ev, ["user_id", "day"])


@query(
    "A10_distribution_summary",
    " UNION ALL ".join(
        f"""SELECT cohort, '{m}' AS metric, count({m}) AS n, round(avg(CASE WHEN {m} IS NOT NULL THEN 1e0 ELSE 0e0 END),6) AS coverage,
  round(avg({m}),6) AS mean, round(stddev_samp({m}),6) AS sd, round(quantile_cont({m},0.05),6) AS p05, round(quantile_cont({m},0.25),6) AS p25,
  round(quantile_cont({m},0.5),6) AS p50, round(quantile_cont({m},0.75),6) AS p75, round(quantile_cont({m},0.95),6) AS p95,
  round(min({m}),6) AS min, round(max({m}),6) AS max FROM (SELECT cohort, minutes, nullif(rating_mean,0) AS rating_mean, shots_p90 FROM feat) GROUP BY cohort"""
        for m in ("minutes", "rating_mean", "shots_p90")
    ),
    ("feat",),
)
def _(t):
    rows = features(t).withColumn("rating_mean", F.nullif("rating_mean", F.lit(0.0)))
    out = A.distribution_summary(rows, ["minutes", "rating_mean", "shots_p90"], ["cohort"])
    return out.select("cohort", "metric", "n", *r6("coverage", "mean", "sd", "p05", "p25", "p50", "p75", "p95", "min", "max"))


@query(
    "A11_group_quantiles",
    """SELECT cohort, count(*) AS entities, count(*) FILTER (shots_p90>=15) AS passing, round(avg(CASE WHEN shots_p90>=15 THEN 1e0 ELSE 0e0 END),6) AS pass_rate,
  round(quantile_cont(shots_p90,0.5),6) AS shots_p90_median, round(quantile_cont(shots_p90,0.1),6) AS shots_p90_p10 FROM feat GROUP BY cohort""",
    ("feat",),
)
def _(t):
    out = A.group_quantiles(features(t), ["cohort"], "shots_p90", F.col("shots_p90") >= 15)
    return out.select("cohort", "entities", "passing", *r6("pass_rate", "shots_p90_median", "shots_p90_p10"))


CTE["sparse"] = """
SELECT unit, nullif(rating,0) AS rating, nullif(goals,0) AS goals, nullif(saves,0) AS saves, minutes FROM eu"""
CTE_DEPS["sparse"] = ("eu",)


@query(
    "A12_nonnull_profile",
    " UNION ALL ".join(
        f"""SELECT '{p}' AS population, count(*) AS "rows", '{c}' AS "column", round(avg(CASE WHEN {c} IS NOT NULL THEN 1e0 ELSE 0e0 END),6) AS nonnull_rate FROM sparse WHERE {w}"""
        for p, w in (("all", "true"), ("active", "minutes>10"), ("starters", "saves=1"))
        for c in ("rating", "goals", "minutes")
    ),
    ("sparse",),
)
def _(t):
    rows = t.entity_units().select(
        "minutes", *[F.nullif(x, F.lit(0.0)).alias(x) for x in ("rating", "goals", "saves")]
    )
    out = A.nonnull_profile(
        rows, ["rating", "goals", "minutes"],
        {"all": F.lit(True), "active": F.col("minutes") > 10, "starters": F.col("saves") == 1},
    )
    return out.select("population", "rows", "column", *r6("nonnull_rate"))


@query(
    "A13_endpoint_rates",
    """SELECT league, season, count(*) AS sampled, count(*) FILTER (status='FT') AS stats, count(*) FILTER (status<>'NS') AS lineups,
  round(count(*) FILTER (status='FT')*1e0/count(*),6) AS stats_rate, round(count(*) FILTER (status<>'NS')*1e0/count(*),6) AS lineups_rate
FROM u GROUP BY ALL""",
    ("u",),
)
def _(t):
    out = A.endpoint_rates(t.units(), ["league", "season"], {"stats": F.col("status") == "FT", "lineups": F.col("status") != "NS"})
    return out.select("league", "season", "sampled", "stats", "lineups", *r6("stats_rate", "lineups_rate"))


@query(
    "A14_trimmed_mean",
    """SELECT label, dim, round(avg(CASE WHEN n-2*cut<2 OR (k>cut AND k<=n-cut) THEN v END),6) AS trimmed_mean, max(n) AS n FROM (
  SELECT *, CAST(floor(n*0.1e0) AS BIGINT) AS cut FROM (
    SELECT label, dim, v, row_number() OVER (PARTITION BY label, dim ORDER BY v) AS k, count(*) OVER (PARTITION BY label, dim) AS n
    FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim FROM embeddings)))
GROUP BY label, dim""",
)
def _(t):
    rows = t.embeddings.select("label", F.posexplode("embedding").alias("dim", "f")).select("label", "dim", F.col("f").cast("double").alias("v"))
    return ordered.trimmed_mean(rows, ["label", "dim"], "v").select("label", "dim", *r6("trimmed_mean"), "n")


_SETS = """SELECT cohort, metric, list_sort(list(value)) AS v, CAST(count(*) AS BIGINT) AS n FROM fl JOIN top20 USING (entity, cohort, minutes) WHERE value IS NOT NULL GROUP BY ALL"""
_PICKS = scatter_sql(f"SELECT *, unnest(range(1, n+1)) AS i FROM (SELECT *, unnest(range(1, 2001)) AS b FROM ({_SETS}))", 20260718, "b", "i")


@query(
    "A15_bootstrap_ci",
    f"""SELECT cohort, metric, round(quantile_cont(e,0.025),6) AS ci95_low, round(quantile_cont(e,0.975),6) AS ci95_high FROM (
  SELECT cohort, metric, b, avg(CASE WHEN n-2*cut<2 OR (k>cut AND k<=n-cut) THEN x END) AS e FROM (
    SELECT *, CAST(floor(n*0.1e0) AS BIGINT) AS cut, row_number() OVER (PARTITION BY cohort, metric, b ORDER BY x) AS k
    FROM (SELECT cohort, metric, b, n, v[1 + d % n] AS x FROM ({_PICKS}))) GROUP BY ALL) GROUP BY ALL""",
    ("fl", "top20"),
)
def _(t):
    from ..plans.ranking import long_metrics, top_members
    from .windows_q import metric_table

    long = long_metrics(top_members(ranked(t), 20), metric_table(t), ["entity", "cohort"])
    out = bootstrap_ci(long, ["cohort", "metric"], "value", seed=20260718, resamples=2000)
    return out.select("cohort", "metric", *r6("ci95_low", "ci95_high"))


def ft_units(t):
    return t.units().where(F.col("status") == "FT")


def unit_shots(t):
    """Exact shots per finished unit (all lines) and captured ones (shipped lines)."""
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("unit")).agg(
        F.sum(F.col("l_quantity")).alias("exact"),
        F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0)).alias("captured"),
    )
    return per.join(ft_units(t).select("unit"), "unit")


CTE["ft"] = "SELECT * FROM u WHERE status='FT'"
CTE_DEPS["ft"] = ("u",)


@query(
    "A16_calibration_targets",
    """SELECT a.*, round(captured/exact,6) AS capture_rate, round(least(greatest(exact/captured,1e0),1.4e0),6) AS adjustment,
  round(mean_captured*least(greatest(exact/captured,1e0),1.4e0),6) AS adjusted_shots
FROM (SELECT count(*) AS units, round(avg(CAST(home_goals+away_goals AS DOUBLE)),6) AS mean_goals, round(stddev_samp(CAST(home_goals+away_goals AS DOUBLE)),6) AS sd_goals,
  round(avg(CASE WHEN home_goals+away_goals=0 THEN 1e0 ELSE 0e0 END),6) AS rate_nil_nil, round(avg(CASE WHEN home_goals>away_goals THEN 1e0 ELSE 0e0 END),6) AS rate_home,
  round(avg(CASE WHEN home_goals=away_goals THEN 1e0 ELSE 0e0 END),6) AS rate_draw, round(avg(CASE WHEN home_goals<away_goals THEN 1e0 ELSE 0e0 END),6) AS rate_away FROM ft) a,
 (SELECT sum(e) AS exact, sum(c) AS captured, avg(c) AS mean_captured FROM (
   SELECT l_orderkey, sum(l_quantity) AS e, sum(CASE WHEN l_linestatus='F' THEN l_quantity ELSE 0e0 END) AS c FROM lineitem JOIN ft ON l_orderkey=unit GROUP BY l_orderkey)) b""",
    ("ft",),
)
def _(t):
    out = A.calibration_targets(ft_units(t), unit_shots(t))
    return out.select("units", *r6(*[x for x in out.columns if x != "units"]))


_WORLDS = 200
_FT = "SELECT home_goals, away_goals, row_number() OVER (ORDER BY unit)-1 AS i, count(*) OVER () AS n FROM u WHERE status='FT'"
_DRAWN = scatter_sql(f"SELECT i, n, unnest(range(1, {_WORLDS})) AS world FROM ft0", 7, "world", "i")


@query(
    "A17_bootstrap_worlds",
    f"""WITH ft0 AS ({_FT})
SELECT world, CAST(count(*) AS BIGINT) AS units, round(avg(CAST(home_goals+away_goals AS DOUBLE)),6) AS mean_goals, round(avg(CASE WHEN home_goals=away_goals THEN 1e0 ELSE 0e0 END),6) AS rate_draw
FROM (SELECT CAST(0 AS INTEGER) AS world, home_goals, away_goals FROM ft0
  UNION ALL SELECT CAST(x.world AS INTEGER), f.home_goals, f.away_goals FROM (SELECT world, d % n AS j FROM ({_DRAWN})) x JOIN ft0 f ON f.i=x.j) GROUP BY world""",
    ("u",),
)
def _(t):
    worlds = bootstrap_worlds(ft_units(t).select("unit", "home_goals", "away_goals"), ["unit"], _WORLDS, 7, ["home_goals", "away_goals"])
    g = (F.col("home_goals") + F.col("away_goals")).cast("double")
    w = F.col("weight")
    return worlds.groupBy("world").agg(
        F.sum(w).alias("units"),
        F.round(F.sum(g * w) / F.sum(w), 6).alias("mean_goals"),
        F.round(F.sum(F.when(F.col("home_goals") == F.col("away_goals"), w).otherwise(0)) / F.sum(w), 6).alias("rate_draw"),
    )


@query(
    "A18_value_distribution",
    """SELECT league, home_goals, n, round(n*1e0/sum(n) OVER (PARTITION BY league),6) AS share
FROM (SELECT league, home_goals, count(*) AS n FROM u GROUP BY ALL)""",
    ("u",),
)
def _(t):
    return A.value_distribution(t.units(), ["league"], "home_goals").select("league", "home_goals", "n", *r6("share"))


@query(
    "A19_convergence_checkpoints",
    """SELECT league, checkpoint, count(*) AS n, round(avg(CASE WHEN home_goals>away_goals THEN 1e0 ELSE 0e0 END),6) AS home_rate,
  round(avg(CAST(home_goals+away_goals AS DOUBLE)),6) AS mean_goals
FROM (SELECT *, row_number() OVER (PARTITION BY league ORDER BY unit) AS i FROM u) JOIN (VALUES (10),(100),(500)) c(checkpoint) ON i<=checkpoint GROUP BY ALL""",
    ("u",),
)
def _(t):
    out = A.convergence_checkpoints(
        t.units(), ["league"], ["unit"], [10, 100, 500],
        {
            "home_rate": F.avg((F.col("home_goals") > F.col("away_goals")).cast("double")),
            "mean_goals": F.avg((F.col("home_goals") + F.col("away_goals")).cast("double")),
        },
    )
    return out.select("league", "checkpoint", "n", *r6("home_rate", "mean_goals"))


CTE["worldrows"] = """
SELECT league AS scenario, season AS combination, home AS world, CAST(home_goals-away_goals AS DOUBLE) AS value FROM u"""
CTE_DEPS["worldrows"] = ("u",)
CTE["combos"] = """
SELECT scenario, combination, avg(wm) AS mean, count(*) AS worlds, quantile_cont(wm,0.025) AS q025, quantile_cont(wm,0.975) AS q975
FROM (SELECT scenario, combination, world, avg(value) AS wm FROM worldrows GROUP BY ALL) GROUP BY ALL"""
CTE_DEPS["combos"] = ("worldrows",)


@query(
    "A20_hierarchical_summary",
    """SELECT scenario, count(*) AS combinations, round(min(mean),6) AS mean_low, round(max(mean),6) AS mean_high, round(min(q025),6) AS low, round(max(q975),6) AS high,
  CASE WHEN bool_and(mean>0) THEN 'positive' WHEN bool_and(mean<0) THEN 'negative' ELSE 'undetermined' END AS direction FROM combos GROUP BY scenario""",
    ("combos",),
)
def _(t):
    rows = t.units().select(
        F.col("league").alias("scenario"), F.col("season").alias("combination"), F.col("home").alias("world"),
        (F.col("home_goals") - F.col("away_goals")).cast("double").alias("value"),
    )
    _combos, env = A.hierarchical_summary(rows, "scenario", ["combination"], "world", "value")
    return env.select("scenario", "combinations", *r6("mean_low", "mean_high", "low", "high"), "direction")


@query(
    "A21_interval_summary",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, round(avg({m}),6) AS mean, round(quantile_cont({m},0.025),6) AS p025, round(quantile_cont({m},0.1),6) AS p10,
  round(quantile_cont({m},0.5),6) AS p50, round(quantile_cont({m},0.9),6) AS p90, round(quantile_cont({m},0.975),6) AS p975,
  (SELECT round(avg(CASE WHEN shots_p90>duels_p90 THEN 1e0 ELSE 0e0 END),6) FROM feat) AS p_a_over_b FROM feat"""
        for m in ("shots_p90", "duels_p90")
    ),
    ("feat",),
)
def _(t):
    out = A.interval_summary(features(t), ["shots_p90", "duels_p90"], "shots_p90", "duels_p90")
    return out.select("metric", *r6("mean", "p025", "p10", "p50", "p90", "p975", "p_a_over_b"))


@query(
    "A22_weighted_group_mean",
    """SELECT cohort, members, round(shots_p90,6) AS shots_p90, round(goals_p90,6) AS goals_p90,
  round((shots_p90-avg(shots_p90) OVER ())/greatest(stddev_pop(shots_p90) OVER (),1e-9),6) AS z FROM (
  SELECT cohort, count(*) AS members, sum(w*shots_p90)/sum(w) AS shots_p90, sum(w*goals_p90)/sum(w) AS goals_p90 FROM (
    SELECT *, sqrt(greatest(minutes,90e0)) AS w, row_number() OVER (PARTITION BY cohort ORDER BY shots_p90 DESC, entity) AS rn FROM feat) WHERE rn<=18 GROUP BY cohort)""",
    ("feat",),
)
def _(t):
    out = A.weighted_group_mean(features(t), "cohort", "entity", "shots_p90", 18, ["shots_p90", "goals_p90"])
    return out.select("cohort", "members", *r6("shots_p90", "goals_p90", "z"))


@query(
    "A23_side_unit_features",
    """SELECT unit, side, round(coalesce(sum(rating*minutes)/nullif(sum(minutes),0),6.5e0),6) AS rating, sum(shots) AS shots,
  round(coalesce(sum(passes_accurate)/nullif(sum(passes),0),0.75e0),6) AS pass_accuracy, round(coalesce(sum(duels_won)/nullif(sum(duels),0),0.5e0),6) AS duel_success
FROM eu GROUP BY ALL""",
    ("eu",),
)
def _(t):
    out = A.side_unit_features(t.entity_units(), ["unit", "side"])
    return out.select("unit", "side", "shots", *r6("rating", "pass_accuracy", "duel_success"))


@query(
    "A25_cohen_kappa",
    """SELECT n, round(po,6) AS observed, round(pe,6) AS expected, round(CASE WHEN pe=1 THEN 1e0 ELSE (po-pe)/(1-pe) END,6) AS kappa FROM (
  SELECT n, same*1e0/n AS po, (q1*1e0*t1 + (n-q1)*1e0*(n-t1))/(n*1e0*n) AS pe FROM (
    SELECT count(*) AS n, count(*) FILTER (quality=toxic) AS same, count(*) FILTER (quality=1) AS q1, count(*) FILTER (toxic=1) AS t1 FROM labels))""",
)
def _(t):
    return A.cohen_kappa(t.labels, "quality", "toxic").select("n", *r6("observed", "expected", "kappa"))


@query(
    "A26_confusion_matrix",
    """SELECT label, count(toxic) FILTER (toxic=0) AS pred_0, count(toxic) FILTER (toxic=1) AS pred_1, count(toxic) FILTER (toxic=2) AS pred_2
FROM (VALUES (0),(1),(2)) s(label) LEFT JOIN labels ON quality=label GROUP BY label""",
)
def _(t):
    spine = literal_table(t.spark, [("label", "int")], [(0,), (1,), (2,)])
    return A.confusion_matrix(t.labels, "quality", "toxic", [0, 1, 2], spine)


CTE["setrows"] = """
SELECT DISTINCT CAST(season AS VARCHAR) AS scenario, home_id AS member FROM u"""
CTE_DEPS["setrows"] = ("u",)


@query(
    "A27_jaccard_stability",
    """SELECT s.scenario, count(*) AS set_n, count(b.member) AS both_n, round(count(b.member)*1e0/(count(*)+(SELECT count(*) FROM setrows WHERE scenario='1996')-count(b.member)),6) AS jaccard,
  count(*)+(SELECT count(*) FROM setrows WHERE scenario='1996')-2*count(b.member) AS symmetric_difference
FROM setrows s LEFT JOIN (SELECT member FROM setrows WHERE scenario='1996') b ON s.member=b.member GROUP BY s.scenario""",
    ("setrows",),
)
def _(t):
    rows = t.units().select(F.col("season").cast("string").alias("scenario"), F.col("home_id").alias("member"))
    return A.jaccard_stability(rows, "scenario", "member", "1996").select("scenario", "set_n", "both_n", *r6("jaccard"), "symmetric_difference")


@query(
    "A28_distribution_string",
    """SELECT user_id, string_agg(event_type || ':' || n, ' | ' ORDER BY n DESC, event_type) AS distribution
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""",
)
def _(t):
    return A.distribution_string(t.events, ["user_id"], "event_type")


@query(
    "A29_pivot_windows",
    """SELECT entity, max(units) FILTER ("window"='current') AS units_current, max(minutes) FILTER ("window"='current') AS minutes_current,
  max(units) FILTER ("window"='pre') AS units_pre, max(minutes) FILTER ("window"='pre') AS minutes_pre
FROM (SELECT entity, "window", count(DISTINCT unit) AS units, sum(minutes) AS minutes FROM ddw GROUP BY ALL) GROUP BY entity""",
    ("ddw",),
)
def _(t):
    rows = window_membership(dated_details(t), WINDOWS)
    totals = A.window_totals(rows, ["entity", "window"], "unit", ["minutes"], F.col("source") == "startXI")
    return A.pivot_windows(totals, "entity", "window", ["current", "pre"], ["units", "minutes"])


CTE["effects"] = """
SELECT CASE WHEN status='FT' THEN 'alt' ELSE 'ref' END AS fa, CASE WHEN official THEN 'alt' ELSE 'ref' END AS fb,
 CAST(home_goals AS DOUBLE) AS gh, CAST(away_goals AS DOUBLE) AS ga FROM u"""
CTE_DEPS["effects"] = ("u",)


@query(
    "A32_factor_effects",
    " UNION ALL ".join(
        f"SELECT '{f}' AS factor, '{m}' AS metric, round(avg(CASE WHEN {f}='alt' THEN {m} END)-avg(CASE WHEN {f}='ref' THEN {m} END),6) AS effect FROM effects"
        for f in ("fa", "fb")
        for m in ("gh", "ga")
    ),
    ("effects",),
)
def _(t):
    rows = t.units().select(
        F.when(F.col("status") == "FT", "alt").otherwise("ref").alias("fa"), F.when(F.col("official"), "alt").otherwise("ref").alias("fb"),
        F.col("home_goals").cast("double").alias("gh"), F.col("away_goals").cast("double").alias("ga"),
    )
    out = A.factor_effects(rows, {"fa": ("ref", "alt"), "fb": ("ref", "alt")}, ["gh", "ga"])
    return out.select("factor", "metric", *r6("effect"))


@query(
    "A33_profile_gap",
    " UNION ALL ".join(
        f"""SELECT a.cohort, '{m}' AS dimension, round(a.{m},6) AS real_mean, round(b.{m},6) AS synthetic, round(a.{m}-b.{m},6) AS gap
FROM (SELECT cohort, avg({m}) AS {m} FROM feat GROUP BY cohort) a JOIN (SELECT cohort, median({m}) AS {m} FROM feat GROUP BY cohort) b USING (cohort)"""
        for m in ("shots_p90", "goals_p90")
    ),
    ("feat",),
)
def _(t):
    f = features(t)
    q = ordered.quantiles(f, ["cohort"], ["shots_p90", "goals_p90"], {"m": 0.5})
    synth = q.select("cohort", F.col("shots_p90_m").alias("shots_p90"), F.col("goals_p90_m").alias("goals_p90"))
    out = A.profile_gap(f, synth, "cohort", ["shots_p90", "goals_p90"])
    return out.select("cohort", "dimension", *r6("real_mean", "synthetic", "gap"))


@query(
    "A34_canonicalise_ids",
    """SELECT l_partkey AS entity, first(l_returnflag ORDER BY l_quantity DESC, l_returnflag) AS name, sum(l_quantity) AS minutes, sum(CAST(l_linenumber AS DOUBLE)) AS shots
FROM lineitem GROUP BY l_partkey""",
)
def _(t):
    rows = t.lineitem.select(
        F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("name"), F.col("l_quantity").alias("minutes"), F.col("l_linenumber").cast("double").alias("shots")
    )
    return A.canonicalise_ids(rows, "entity", ["minutes", "shots"], "name", "minutes")


@query(
    "A35_unit_value_queue",
    """SELECT unit, count(DISTINCT entity) AS entities, max(minutes) AS max_priority, sum(minutes) AS total_priority,
  round(1e0*sum(minutes)+0.5e0*max(minutes)+2e0*ln(1+count(DISTINCT entity)),6) AS information_value FROM det GROUP BY unit""",
    ("det",),
)
def _(t):
    out = A.unit_value_queue(t.details(), "unit", "entity", "minutes", (1.0, 0.5, 2.0))
    return out.select("unit", "entities", "max_priority", "total_priority", *r6("information_value"))


@query(
    "A36_progress_counts",
    """SELECT u.status, count(*) AS units, count(x.unit) AS target_units FROM u LEFT JOIN (SELECT DISTINCT unit FROM det WHERE minutes>=45) x ON u.unit=x.unit GROUP BY u.status""",
    ("u", "det"),
)
def _(t):
    return A.progress_counts(t.units(), "status", "unit", t.details().where(F.col("minutes") >= 45))


@query(
    "A37_gate_table",
    """SELECT g.metric, g.kind, g.threshold, round(v.value,6) AS value, CASE WHEN kind='min' THEN v.value>=threshold ELSE abs(v.value)<=threshold END AS passed
FROM (VALUES ('official_share','min',0.75e0),('finished_share','min',0.9e0),('goal_gap','max_abs',0.2e0)) g(metric,kind,threshold)
JOIN (UNPIVOT (SELECT avg(CASE WHEN official THEN 1e0 ELSE 0e0 END) AS official_share, avg(CASE WHEN status<>'NS' THEN 1e0 ELSE 0e0 END) AS finished_share,
   avg(CAST(home_goals-away_goals AS DOUBLE)) AS goal_gap FROM u) ON official_share, finished_share, goal_gap INTO NAME metric VALUE value) v USING (metric)""",
    ("u",),
)
def _(t):
    metrics = t.units().agg(
        F.avg(F.col("official").cast("double")).alias("official_share"),
        F.avg((F.col("status") != "NS").cast("double")).alias("finished_share"),
        F.avg((F.col("home_goals") - F.col("away_goals")).cast("double")).alias("goal_gap"),
    )
    limits = literal_table(
        t.spark, [("metric", "string"), ("kind", "string"), ("threshold", "double")],
        [("official_share", "min", 0.75), ("finished_share", "min", 0.9), ("goal_gap", "max_abs", 0.2)],
    )
    return A.gate_table(metrics, limits).select("metric", "kind", "threshold", *r6("value"), "passed")


@query(
    "A38_representation_choice",
    """SELECT cohort, first(src ORDER BY p) FILTER (cov>=0.8) AS chosen, count(*) FILTER (cov>=0.8) AS qualifying FROM (
  SELECT cohort, 'rated' AS src, 1 AS p, avg(CASE WHEN rating>0 THEN 1e0 ELSE 0e0 END) AS cov FROM eu GROUP BY cohort UNION ALL
  SELECT cohort, 'started', 2, avg(saves) FROM eu GROUP BY cohort UNION ALL SELECT cohort, 'any', 3, 1e0 FROM eu GROUP BY cohort) GROUP BY cohort""",
    ("eu",),
)
def _(t):
    wide = t.entity_units().groupBy("cohort").agg(
        F.avg((F.col("rating") > 0).cast("double")).alias("rated"), F.avg("saves").alias("started"), F.avg(F.lit(1.0)).alias("any")
    )
    long = wide.unpivot(["cohort"], ["rated", "started", "any"], "source", "coverage")
    return A.representation_choice(long, ["cohort"], "source", "coverage", {"rated": 1, "started": 2, "any": 3})


@query(
    "A39_consistency_flags",
    """SELECT unit, status, (status='NS' AND home_goals>0) AS unplayed_with_goals, (official AND league=5) AS friendly_official, (dup>1) AS duplicate_key,
  CAST(status='NS' AND home_goals>0 AS INTEGER)+CAST(official AND league=5 AS INTEGER)+CAST(dup>1 AS INTEGER) AS anomalies
FROM (SELECT *, count(*) OVER (PARTITION BY unit) AS dup FROM u)""",
    ("u",),
)
def _(t):
    rules = {
        "unplayed_with_goals": (F.col("status") == "NS") & (F.col("home_goals") > 0),
        "friendly_official": F.col("official") & (F.col("league") == 5),
    }
    out = A.consistency_flags(t.units(), rules, "unit")
    return out.select("unit", "status", "unplayed_with_goals", "friendly_official", "duplicate_key", "anomalies")


@query(
    "A40_provider_support_summary",
    """SELECT l_returnflag, l_linestatus, nullif(l_linenumber,7) AS line, count(*) AS n, count(DISTINCT l_orderkey) AS units, count(DISTINCT l_suppkey) AS entities, sum(l_quantity) AS minutes
FROM lineitem GROUP BY ALL""",
)
def _(t):
    rows = t.lineitem.withColumn("line", F.nullif("l_linenumber", F.lit(7)))
    return A.provider_support_summary(rows, ["l_returnflag", "l_linestatus", "line"], "l_orderkey", "l_suppkey", "l_quantity")


@query(
    "A41_competition_inventory",
    "SELECT league, season, count(*) AS units, count(*) FILTER (in_current) AS units_in_current, count(*) FILTER (in_pre) AS units_in_pre FROM u GROUP BY ALL",
    ("u",),
)
def _(t):
    return A.competition_inventory(t.units(), ["league", "season"], ["in_current", "in_pre"])


@query(
    "A42_entity_universe",
    """SELECT s_suppkey AS entity, coalesce(bool_or(season=1996),false) AS in_1996, coalesce(bool_or(season=2001),false) AS in_2001, count(season) AS lines, coalesce(sum(minutes),0e0) AS total_exposure
FROM supplier LEFT JOIN (SELECT entity, season, minutes FROM dd) d ON s_suppkey=entity GROUP BY s_suppkey""",
    ("dd",),
)
def _(t):
    roster = t.supplier.select(F.col("s_suppkey").alias("entity"))
    return A.entity_universe(roster, dated_details(t), "entity", "season", [1996, 2001], "minutes")


@query(
    "A43_spine_counts",
    """SELECT role, count(DISTINCT p_partkey) AS entities FROM (VALUES ('SMALL'),('PROMO'),('LARGE'),('NONE')) s(role) LEFT JOIN part ON p_type=role GROUP BY role""",
)
def _(t):
    spine = literal_table(t.spark, [("role", "string")], [("SMALL",), ("PROMO",), ("LARGE",), ("NONE",)])
    return A.spine_counts(t.part.withColumnRenamed("p_type", "role"), "role", "p_partkey", spine)


@query(
    "A44_transition_counts",
    """SELECT season, count(*) FILTER (NOT a AND b) AS false_to_true, count(*) FILTER (a AND NOT b) AS true_to_false, count(DISTINCT home_id) FILTER (a<>b) AS entities_changed
FROM (SELECT season, home_id, home_goals>away_goals AS a, home_goals>=away_goals AND league<4 AS b FROM u) GROUP BY season""",
    ("u",),
)
def _(t):
    before = F.col("home_goals") > F.col("away_goals")
    after = (F.col("home_goals") >= F.col("away_goals")) & (F.col("league") < 4)
    return A.transition_counts(t.units(), "season", "home_id", before, after)


@query(
    "A45_eligibility_change",
    """SELECT r.entity, reported_minutes, coalesce(m,0e0) AS exact_minutes, reported_minutes>=8000 AS old_eligible, coalesce(m,0e0)>=8000 AS exact_eligible,
  reported_minutes>=8000 AND NOT coalesce(m,0e0)>=8000 AS changed_to_ineligible
FROM (SELECT l_suppkey AS entity, sum(l_quantity) AS reported_minutes FROM lineitem GROUP BY 1) r
LEFT JOIN (SELECT entity, sum(minutes) AS m FROM dd WHERE in_current OR in_pre GROUP BY 1) x USING (entity)""",
    ("dd",),
)
def _(t):
    reported = t.lineitem.groupBy(F.col("l_suppkey").alias("entity")).agg(F.sum("l_quantity").alias("reported_minutes"))
    exact = dated_details(t).where(F.col("in_current") | F.col("in_pre")).groupBy("entity").agg(F.sum("minutes").alias("exact_minutes"))
    return A.eligibility_change(reported, exact, "entity", 8000.0)


@query(
    "A46_side_record",
    """SELECT side, count(*) AS matches, CAST(sum(gf) AS BIGINT) AS goals_for, CAST(sum(ga) AS BIGINT) AS goals_against, count(*) FILTER (ga=0) AS clean_sheets
FROM (SELECT home AS side, home_goals AS gf, away_goals AS ga FROM ft UNION ALL SELECT away, away_goals, home_goals FROM ft) GROUP BY side""",
    ("ft",),
)
def _(t):
    return A.side_record(two_side_rows(ft_units(t), ["unit"]), "side")


@query(
    "A47_metric_error_table",
    """SELECT metric, round(observed,6) AS observed, round(candidate,6) AS candidate, round(abs(candidate-observed),6) AS abs_error, round(candidate/nullif(observed,0),6) AS ratio FROM (
  SELECT 'home' AS metric, avg(CAST(home_goals AS DOUBLE)) AS observed, avg(CASE WHEN official THEN CAST(home_goals AS DOUBLE) END) AS candidate FROM u UNION ALL
  SELECT 'away', avg(CAST(away_goals AS DOUBLE)), avg(CASE WHEN official THEN CAST(away_goals AS DOUBLE) END) FROM u)""",
    ("u",),
)
def _(t):
    stats = lambda df: df.agg(F.avg(F.col("home_goals").cast("double")).alias("home"), F.avg(F.col("away_goals").cast("double")).alias("away"))
    out = A.metric_error_table(stats(t.units()), stats(t.units().where("official")))
    return out.select("metric", *r6("observed", "candidate", "abs_error", "ratio"))
