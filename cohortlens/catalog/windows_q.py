"""Window, sort and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered, sets, windows
from ..operators.aggregates import entity_features
from ..operators.ordered import By
from ..operators.tables import literal_table
from ..plans import ranking
from .base import CTE, CTE_DEPS, query

# Cohort metric matrix of the shared-table binding: (cohort, metric, direction).
COHORTS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
METRICS = (("shots_p90", 1), ("goals_p90", 1), ("saves_p90", 1), ("cards_p90", -1), ("pass_accuracy", 1), ("duel_win_rate", 1))


def metric_table(t):
    rows = [(co, m, d) for co in COHORTS for m, d in METRICS if not (co == "SMALL" and m == "saves_p90")]
    return literal_table(t.spark, [("cohort", "string"), ("metric", "string"), ("direction", "int")], rows)


def features(t):
    return entity_features(
        t.entity_units(),
        ["entity", "entity_name", "cohort"],
        ["shots", "goals", "saves", "passes", "passes_accurate", "duels", "duels_won", "yellow", "red"],
        ["shots", "goals", "saves", "passes", "duels"],
        {"pass_accuracy": ("passes_accurate", "passes", 100.0), "duel_win_rate": ("duels_won", "duels", 1.0)},
        rating="rating",
        rating_key="entity",
        cards=("yellow", "red"),
    )


CTE["feat"] = """
SELECT s.*, coalesce(r.rating_mean, 0e0) AS rating_mean,
  CASE WHEN minutes>0 THEN shots*90e0/minutes ELSE 0e0 END AS shots_p90,
  CASE WHEN minutes>0 THEN goals*90e0/minutes ELSE 0e0 END AS goals_p90,
  CASE WHEN minutes>0 THEN saves*90e0/minutes ELSE 0e0 END AS saves_p90,
  CASE WHEN minutes>0 THEN passes*90e0/minutes ELSE 0e0 END AS passes_p90,
  CASE WHEN minutes>0 THEN duels*90e0/minutes ELSE 0e0 END AS duels_p90,
  CASE WHEN minutes>0 THEN (yellow+2*red)*90e0/minutes ELSE 0e0 END AS cards_p90,
  CASE WHEN passes>0 THEN 100e0*passes_accurate/passes ELSE 0e0 END AS pass_accuracy,
  CASE WHEN duels>0 THEN duels_won/duels ELSE 0e0 END AS duel_win_rate
FROM (SELECT entity, entity_name, cohort, sum(minutes) AS minutes, sum(shots) AS shots, sum(goals) AS goals,
        sum(saves) AS saves, sum(passes) AS passes, sum(passes_accurate) AS passes_accurate, sum(duels) AS duels,
        sum(duels_won) AS duels_won, sum(yellow) AS yellow, sum(red) AS red
      FROM eu GROUP BY ALL) s
LEFT JOIN (SELECT entity, avg(rating) AS rating_mean FROM eu WHERE rating > 0 GROUP BY entity) r USING (entity)"""
CTE_DEPS["feat"] = ("eu",)

CTE["metrics"] = (
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{co}','{m}',{d})" for co in COHORTS for m, d in METRICS if not (co == "SMALL" and m == "saves_p90"))
    + ") v(cohort, metric, direction)"
)
CTE["fl"] = """
SELECT l.entity, l.cohort, l.minutes, l.metric, l.value, m.direction FROM (
  UNPIVOT (SELECT entity, cohort, minutes, shots_p90, goals_p90, saves_p90, cards_p90, pass_accuracy, duel_win_rate FROM feat)
  ON shots_p90, goals_p90, saves_p90, cards_p90, pass_accuracy, duel_win_rate INTO NAME metric VALUE value) l
JOIN metrics m ON l.cohort = m.cohort AND l.metric = m.metric"""
CTE_DEPS["fl"] = ("feat", "metrics")
CTE["ranked"] = """
SELECT f.*, x.rank_score, rank() OVER (PARTITION BY f.cohort ORDER BY x.rank_score DESC) AS position_rank,
  f.minutes/(f.minutes+180e0) AS reliability
FROM feat f JOIN (
  SELECT entity, cohort, round(avg(z*direction), 9) AS rank_score FROM (
    SELECT *, CASE WHEN stddev_pop(c) OVER w > 0 THEN (c - avg(c) OVER w)/stddev_pop(c) OVER w ELSE 0e0 END AS z FROM (
      SELECT *, CASE WHEN count(*) OVER w >= 5 THEN greatest(least(adj, quantile_cont(adj, 0.95) OVER w), quantile_cont(adj, 0.05) OVER w) ELSE adj END AS c FROM (
        SELECT *, avg(value) OVER w + minutes/(minutes+180e0)*(value - avg(value) OVER w) AS adj
        FROM fl WHERE minutes >= 180 WINDOW w AS (PARTITION BY cohort, metric))
      WINDOW w AS (PARTITION BY cohort, metric))
    WINDOW w AS (PARTITION BY cohort, metric))
  GROUP BY entity, cohort) x USING (entity, cohort)
WHERE f.minutes >= 180"""
CTE_DEPS["ranked"] = ("fl",)
CTE["top20"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY rank_score DESC, entity) AS rn FROM ranked) WHERE rn <= 20"""
CTE_DEPS["top20"] = ("ranked",)
CTE["cent"] = """
SELECT cohort, metric, any_value(direction) AS direction, count(*) AS actual_n, avg(value) AS arithmetic_mean,
  median(value) AS median, coalesce(stddev_samp(value), 0e0) AS std,
  avg(CASE WHEN (n - 2*cut < 2) OR (k > cut AND k <= n - cut) THEN value END) AS mean
FROM (SELECT *, CAST(floor(n*0.1e0) AS BIGINT) AS cut FROM (
  SELECT fl.*, row_number() OVER (PARTITION BY fl.cohort, metric ORDER BY value) AS k, count(*) OVER (PARTITION BY fl.cohort, metric) AS n
  FROM fl JOIN top20 USING (entity, cohort)))
GROUP BY cohort, metric"""
CTE_DEPS["cent"] = ("fl", "top20")


def ranked(t):
    return ranking.rank_cohort(features(t), metric_table(t))


@query(
    "K4_rank_cohort",
    "SELECT entity, cohort, minutes, round(rank_score,6) AS rank_score, position_rank, round(reliability,9) AS reliability FROM ranked",
    ("ranked",),
)
def _(t):
    return ranked(t).select(
        "entity", "cohort", "minutes", F.round("rank_score", 6).alias("rank_score"), "position_rank",
        F.round("reliability", 9).alias("reliability"),
    )


@query(
    "K5_build_centroids",
    """SELECT c.cohort, c.metric, c.direction, c.actual_n, round(c.mean,6) AS mean, round(c.arithmetic_mean,6) AS arithmetic_mean,
  round(c.median,6) AS median, round(c.std,6) AS std, round(p.percentile,6) AS percentile
FROM cent c JOIN (
  SELECT f.cohort, f.metric, 100e0*avg(CASE WHEN round(f.value,9) <= round(cent.mean,9) THEN 1e0 ELSE 0e0 END) AS percentile
  FROM fl f JOIN ranked r USING (entity, cohort) JOIN cent ON cent.cohort=f.cohort AND cent.metric=f.metric GROUP BY ALL) p
ON c.cohort=p.cohort AND c.metric=p.metric""",
    ("cent", "ranked"),
)
def _(t):
    cent, _summary = ranking.build_centroids(ranked(t), metric_table(t))
    return cent.select(
        "cohort", "metric", "direction", "actual_n", *[F.round(x, 6).alias(x) for x in ("mean", "arithmetic_mean", "median", "std", "percentile")]
    )


CTE["w0"] = "SELECT entity, cohort, minutes, shots_p90, goals_p90, saves_p90, shots FROM feat"
CTE_DEPS["w0"] = ("feat",)


def slim(t):
    return features(t).select("entity", "cohort", "minutes", "shots_p90", "goals_p90", "saves_p90", "shots")


@query("W1_competition_rank", "SELECT entity, cohort, shots, rank() OVER (PARTITION BY cohort ORDER BY shots DESC) AS position_rank FROM w0", ("w0",))
def _(t):
    return ordered.competition_rank(slim(t), ["cohort"], "shots", "position_rank").select("entity", "cohort", "shots", "position_rank")


@query(
    "W2_order_rank",
    """SELECT entity, cohort, row_number() OVER (PARTITION BY cohort ORDER BY goals_p90 DESC, minutes DESC, entity) AS role_rank,
  row_number() OVER (PARTITION BY cohort ORDER BY round(goals_p90+1/sqrt(minutes),9) DESC, minutes DESC, entity) AS upper_rank FROM w0""",
    ("w0",),
)
def _(t):
    f = slim(t).withColumn("upper", F.round(F.col("goals_p90") + 1 / F.sqrt("minutes"), 9))
    one = windows.order_rank(f, ["cohort"], [By("goals_p90", True), By("minutes", True), "entity"], "role_rank")
    two = windows.order_rank(one, ["cohort"], [By("upper", True), By("minutes", True), "entity"], "upper_rank")
    return two.select("entity", "cohort", "role_rank", "upper_rank")


@query(
    "W3_pct_rank_avg",
    """SELECT entity, cohort, round((rank() OVER (PARTITION BY cohort ORDER BY shots) + (count(*) OVER (PARTITION BY cohort, shots)-1)/2e0)/count(*) OVER (PARTITION BY cohort),6) AS pct FROM w0""",
    ("w0",),
)
def _(t):
    return ordered.pct_rank_avg(slim(t), ["cohort"], "shots", "pct").select("entity", "cohort", F.round("pct", 6).alias("pct"))


CTE["wz"] = """
SELECT *, CASE WHEN stddev_pop(c) OVER w > 0 THEN (c-avg(c) OVER w)/stddev_pop(c) OVER w ELSE 0e0 END AS z FROM (
  SELECT *, CASE WHEN count(*) OVER w >= 5 THEN greatest(least(goals_p90, quantile_cont(goals_p90,0.95) OVER w), quantile_cont(goals_p90,0.05) OVER w) ELSE goals_p90 END AS c
  FROM w0 WINDOW w AS (PARTITION BY cohort)) WINDOW w AS (PARTITION BY cohort)"""
CTE_DEPS["wz"] = ("w0",)


@query("W4_winsorised_z", "SELECT entity, cohort, round(z,6) AS z FROM wz", ("wz",))
def _(t):
    return windows.winsorised_z(slim(t), ["cohort"], "goals_p90", "z").select("entity", "cohort", F.round("z", 6).alias("z"))


@query(
    "W5_shrink_to_cohort",
    """SELECT entity, cohort, round(avg(goals_p90) OVER (PARTITION BY cohort) + minutes/(minutes+180e0)*(goals_p90-avg(goals_p90) OVER (PARTITION BY cohort)),6) AS adjusted FROM w0""",
    ("w0",),
)
def _(t):
    out = windows.shrink_to_cohort(slim(t), ["cohort"], "goals_p90", "minutes", 180.0, "adjusted")
    return out.select("entity", "cohort", F.round("adjusted", 6).alias("adjusted"))


@query(
    "W6_robust_unit",
    """SELECT entity, round(1e0/(1e0+exp(-least(greatest((goals_p90-q2)/greatest(q3-q1,1e-9),-8e0),8e0))),6) AS unit_score
FROM w0, (SELECT quantile_cont(goals_p90,0.25) AS q1, quantile_cont(goals_p90,0.5) AS q2, quantile_cont(goals_p90,0.75) AS q3 FROM w0)""",
    ("w0",),
)
def _(t):
    return windows.robust_unit(slim(t), [], {"unit_score": "goals_p90"}).select("entity", F.round("unit_score", 6).alias("unit_score"))


@query(
    "W7_latest_by_key",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_returnflag DESC, l_discount DESC, l_tax DESC, l_linestatus DESC) AS rn FROM lineitem) WHERE rn=1""",
)
def _(t):
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_discount", "l_tax", "l_linestatus"]
    out = windows.latest_by_key(t.lineitem, ["l_orderkey", "l_linenumber"], [F.col(x).desc() for x in order])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")


@query(
    "W8_top_n_per_group",
    "SELECT entity, cohort, shots, rn FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY shots DESC, entity) AS rn FROM w0) WHERE rn<=30",
    ("w0",),
)
def _(t):
    out = windows.top_n_per_group(slim(t), ["cohort"], [F.col("shots").desc(), F.col("entity")], 30, rank="rn")
    return out.select("entity", "cohort", "shots", "rn")


CTE["grid"] = """
SELECT l_orderkey AS unit, s_nationkey % 2 AS side, CAST(l_partkey AS BIGINT) AS entity, CAST(1 + l_linenumber % 5 AS INTEGER) AS row, CAST(1 + l_partkey % 4 AS INTEGER) AS col
FROM lineitem JOIN supplier ON l_suppkey=s_suppkey"""


def grid(t):
    return t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("unit"), (F.col("s_nationkey") % 2).alias("side"), F.col("l_partkey").alias("entity"),
        (1 + F.col("l_linenumber") % 5).alias("row"), (1 + F.col("l_partkey") % 4).cast("int").alias("col"),
    )


@query(
    "W9_group_extent",
    """SELECT unit, side, entity, row, col, max(col) OVER (PARTITION BY unit, side, row) AS row_width,
  round(least(greatest((row-2)*1e0/greatest(max(row) OVER (PARTITION BY unit, side)-2,1),0e0),1e0),6) AS depth FROM grid""",
    ("grid",),
)
def _(t):
    out = windows.group_extent(grid(t))
    return out.select("unit", "side", "entity", "row", "col", "row_width", F.round("depth", 6).alias("depth"))


@query(
    "W10_first_last_sample",
    """SELECT DISTINCT league, season, unit FROM (SELECT *, row_number() OVER (PARTITION BY league, season ORDER BY ts, unit) AS a,
  row_number() OVER (PARTITION BY league, season ORDER BY ts DESC, unit DESC) AS b FROM u) WHERE a=1 OR b=1""",
    ("u",),
)
def _(t):
    rows = t.units().select("league", "season", "ts", "unit")
    return windows.first_last_sample(rows, ["league", "season"], ["ts", "unit"]).select("league", "season", "unit")


@query(
    "W11_sequence_in_group",
    """SELECT unit, league, season, row_number() OVER w - 1 AS seq, count(*) OVER (PARTITION BY league, season) AS group_size,
  row_number() OVER w = count(*) OVER (PARTITION BY league, season) AS is_latest FROM u WINDOW w AS (PARTITION BY league, season ORDER BY ts, unit)""",
    ("u",),
)
def _(t):
    rows = t.units().select("unit", "league", "season", "ts")
    out = windows.sequence_in_group(rows, ["league", "season"], ["ts", "unit"])
    return out.select("unit", "league", "season", "seq", "group_size", "is_latest")


@query(
    "W12_kth_threshold",
    """SELECT cohort, round(min(goals_p90),6) AS kth_value, round(max(goals_p90),6) AS best_value FROM (
  SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY goals_p90 DESC, entity) AS rn FROM w0) WHERE rn<=30 GROUP BY cohort""",
    ("w0",),
)
def _(t):
    out = windows.kth_threshold(slim(t), ["cohort"], "goals_p90", 30, "entity")
    return out.select("cohort", F.round("kth_value", 6).alias("kth_value"), F.round("best_value", 6).alias("best_value"))


@query(
    "W15_ecdf_position",
    """SELECT w0.cohort, round(100e0*avg(CASE WHEN shots<=m THEN 1e0 ELSE 0e0 END),6) AS percentile
FROM w0 JOIN (SELECT cohort, quantile_cont(shots,0.9) AS m FROM w0 GROUP BY cohort) q ON w0.cohort=q.cohort GROUP BY w0.cohort""",
    ("w0",),
)
def _(t):
    f = slim(t)
    points = ordered.quantiles(f, ["cohort"], ["shots"], {"p90": 0.9})
    return windows.ecdf_position(f, points, ["cohort"], "shots", "shots_p90").select("cohort", F.round("percentile", 6).alias("percentile"))


@query(
    "W16_line_index",
    """SELECT unit, side, entity, row, col, dense_rank() OVER (PARTITION BY unit, side ORDER BY row) AS line,
  CAST(count(*) OVER (PARTITION BY unit, side, row) AS INTEGER) AS line_size, row_number() OVER (PARTITION BY unit, side, row ORDER BY col, entity) AS place FROM grid WHERE row<>1""",
    ("grid",),
)
def _(t):
    return windows.line_index(grid(t), ["unit", "side"]).select("unit", "side", "entity", "row", "col", "line", "line_size", "place")


@query(
    "W17_best_of_others",
    """SELECT entity, cohort, round(CASE WHEN entity=top THEN u2 ELSE u1 END,6) AS best_other_upper, goals_p90 > CASE WHEN entity=top THEN u2 ELSE u1 END AS identified FROM (
  SELECT *, goals_p90+shots_p90/100e0 AS up FROM w0) JOIN (
  SELECT cohort, max(entity) FILTER (rn=1) AS top, max(up) FILTER (rn=1) AS u1, max(up) FILTER (rn=2) AS u2 FROM (
    SELECT cohort, entity, goals_p90+shots_p90/100e0 AS up, row_number() OVER (PARTITION BY cohort ORDER BY goals_p90+shots_p90/100e0 DESC, entity) AS rn FROM w0) GROUP BY cohort) USING (cohort)""",
    ("w0",),
)
def _(t):
    f = slim(t).withColumn("up", F.col("goals_p90") + F.col("shots_p90") / 100.0)
    out = windows.best_of_others(f, ["cohort"], "entity", "up", "goals_p90")
    return out.select("entity", "cohort", F.round("best_other_upper", 6).alias("best_other_upper"), "identified")


# Slots of the shared-table binding: (slot, cohort, ordinal).
SLOTS = [(f"{co[:3]}{k}", co, k) for co in (*COHORTS, "MISSING") for k in (1, 2)]


@query(
    "W18_slot_fill_ordinal",
    "SELECT s.slot, s.cohort, s.ordinal, r.entity, r.entity IS NOT NULL AS available FROM (VALUES "
    + ", ".join(f"('{s}','{co}',{k})" for s, co, k in SLOTS)
    + """) s(slot,cohort,ordinal) LEFT JOIN (SELECT entity, cohort, row_number() OVER (PARTITION BY cohort ORDER BY shots DESC, minutes, entity) AS ordinal FROM w0) r
  ON s.cohort=r.cohort AND s.ordinal=r.ordinal""",
    ("w0",),
)
def _(t):
    slots = literal_table(t.spark, [("slot", "string"), ("cohort", "string"), ("ordinal", "int")], SLOTS)
    out = windows.slot_fill_ordinal(slim(t), slots, "cohort", [F.col("shots").desc(), F.col("minutes"), F.col("entity")], 2)
    return out.select("slot", "cohort", "ordinal", "entity", F.col("entity").isNotNull().alias("available"))


@query(
    "W19_slot_fill_greedy",
    "SELECT CAST(s.no AS INTEGER) AS slot_no, s.slot, s.cohort, r.entity FROM (VALUES "
    + ", ".join(f"({i},'{s}','{co}',{k})" for i, (s, co, k) in enumerate(SLOTS, 1))
    + """) s(no,slot,cohort,k) LEFT JOIN (SELECT entity, cohort, row_number() OVER (PARTITION BY cohort ORDER BY shots DESC, minutes DESC, entity) AS k FROM w0) r
  ON s.cohort=r.cohort AND s.k=r.k""",
    ("w0",),
)
def _(t):
    rows = [(i, s, co) for i, (s, co, _k) in enumerate(SLOTS, 1)]
    slots = literal_table(t.spark, [("slot_no", "int"), ("slot", "string"), ("cohort", "string")], rows)
    out = windows.slot_fill_greedy(slim(t), slots, "cohort", "entity", [F.col("shots").desc(), F.col("minutes").desc(), F.col("entity")], len(rows))
    return out.select("slot_no", "slot", "cohort", "entity")


@query(
    "W20_ordered_pick_list",
    """SELECT cohort, string_agg(entity, ',' ORDER BY last, goals_p90 DESC, shots_p90 DESC, entity DESC) AS pick_order, count(*) AS members FROM (
  SELECT *, CAST(saves_p90=max(saves_p90) OVER (PARTITION BY cohort) AS INTEGER) AS last FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY shots DESC, entity) AS rn FROM w0) WHERE rn<=11) GROUP BY cohort""",
    ("w0",),
)
def _(t):
    team = windows.top_n_per_group(slim(t), ["cohort"], [F.col("shots").desc(), F.col("entity")], 11)
    keeper = ordered.with_stats(team, ["cohort"], {"__k": F.max("saves_p90")})
    order = [
        (F.col("saves_p90") == F.col("__k")).cast("int"), F.col("goals_p90").desc(), F.col("shots_p90").desc(), F.col("entity").desc(),
    ]
    return windows.ordered_pick_list(keeper, ["cohort"], "entity", order)


@query(
    "W21_ecdf_curve",
    "SELECT entity, cohort, shots, round(row_number() OVER (PARTITION BY cohort ORDER BY shots, entity)*1e0/count(*) OVER (PARTITION BY cohort),6) AS cum_share FROM w0",
    ("w0",),
)
def _(t):
    out = ordered.ecdf(slim(t), ["cohort"], "shots", ["shots", "entity"])
    return out.select("entity", "cohort", "shots", F.round("cum_share", 6).alias("cum_share"))


@query(
    "W22_sequence_flag",
    """SELECT unit, league, n AS match_number, CAST(n>72 AS INTEGER) AS knockout FROM (SELECT unit, league, row_number() OVER (PARTITION BY league ORDER BY ts, unit) AS n FROM u)""",
    ("u",),
)
def _(t):
    rows = t.units().select("unit", "league", "ts")
    return windows.sequence_flag(rows, ["league"], ["ts", "unit"], 72).select("unit", "league", "match_number", "knockout")


@query(
    "O1_priority_queue",
    """SELECT unit, 100e0*CAST(official AS INTEGER)+10e0*home_goals+50e0*CAST(in_current AND in_pre AS INTEGER)+20e0*CAST(status='FT' AS INTEGER) AS priority FROM u ORDER BY priority DESC, ts DESC, unit LIMIT 500""",
    ("u",),
)
def _(t):
    rows = t.units().withColumn("both", F.col("in_current") & F.col("in_pre")).withColumn("quality", F.col("status") == "FT")
    rows = rows.select("unit", "ts", "home_goals", *[F.col(x).cast("int").alias(x) for x in ("official", "both", "quality")])
    out = sets.priority_queue(rows, {"official": 100.0, "home_goals": 10.0, "both": 50.0, "quality": 20.0}, [F.col("ts").desc(), F.col("unit")], 500)
    return out.select("unit", "priority")


@query(
    "O2_top_values",
    "SELECT score, count(*) AS n FROM (SELECT home_goals || '-' || away_goals AS score FROM u) GROUP BY score ORDER BY n DESC, score LIMIT 10",
    ("u",),
)
def _(t):
    from ..functions.scalar import scoreline

    return sets.top_values(t.units().select(scoreline("home_goals", "away_goals").alias("score")), "score", 10)


@query(
    "O3_nearest_to_mean_row",
    """SELECT entity, round(minutes,6) AS minutes, round(shots,6) AS shots FROM (SELECT *, round(1e0*abs(minutes-avg(minutes) OVER ())+2e0*abs(shots-avg(shots) OVER ()),9) AS d FROM w0) ORDER BY d, entity LIMIT 1""",
    ("w0",),
)
def _(t):
    out = sets.nearest_to_mean_row(slim(t), "entity", {"minutes": 1.0, "shots": 2.0})
    return out.select("entity", F.round("minutes", 6).alias("minutes"), F.round("shots", 6).alias("shots"))


CTE["setab"] = """
SELECT a.k AS home_id, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'a_only' ELSE 'b_only' END AS tag, coalesce(a.k,b.k) AS k
FROM (SELECT DISTINCT home_id AS k FROM u WHERE in_current) a FULL JOIN (SELECT DISTINCT home_id AS k FROM u WHERE in_pre) b ON a.k=b.k"""
CTE_DEPS["setab"] = ("u",)


def _ab(t):
    u = t.units()
    return u.where("in_current").select("home_id"), u.where("in_pre").select("home_id")


@query("U1_tagged_union", "SELECT k AS home_id, tag FROM setab", ("setab",))
def _(t):
    return sets.tagged_union(*_ab(t), "home_id")


@query(
    "U2_two_side_rows",
    """SELECT unit, 'home' AS venue, home AS side, away AS opponent, home_goals AS goals_for, away_goals AS goals_against FROM u
UNION ALL SELECT unit, 'away', away, home, away_goals, home_goals FROM u""",
    ("u",),
)
def _(t):
    return sets.two_side_rows(t.units(), ["unit"])


@query("U3_set_difference", "SELECT k AS home_id, tag FROM setab WHERE tag<>'both'", ("setab",))
def _(t):
    return sets.symmetric_difference(*_ab(t), "home_id")


@query(
    "U4_union_sources",
    """SELECT src, count(*) AS n, count(minutes) AS with_minutes, count(status) AS with_status FROM (
  SELECT 'detail' AS src, unit, minutes, NULL AS status FROM det UNION ALL SELECT 'unit', unit, NULL, status FROM u) GROUP BY src""",
    ("det", "u"),
)
def _(t):
    a = t.details().select(F.lit("detail").alias("src"), "unit", "minutes")
    b = t.units().select(F.lit("unit").alias("src"), "unit", "status")
    return sets.union_sources(a, b).groupBy("src").agg(
        F.count(F.lit(1)).alias("n"), F.count("minutes").alias("with_minutes"), F.count("status").alias("with_status")
    )


@query(
    "U5_frame_equality",
    """SELECT only_in, count(*) AS n FROM (
  SELECT 'a' AS only_in FROM (SELECT l_orderkey, l_linenumber FROM lineitem EXCEPT ALL SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) UNION ALL
  SELECT 'b' FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem EXCEPT ALL SELECT l_orderkey, l_linenumber FROM lineitem)) GROUP BY only_in""",
)
def _(t):
    a = t.lineitem.select("l_orderkey", "l_linenumber")
    return sets.frame_differences(a, a.distinct()).groupBy("only_in").agg(F.count(F.lit(1)).alias("n"))


@query(
    "K6_cohort_best",
    "SELECT cohort, entity, position_rank, minutes FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY position_rank, minutes, entity) AS rn FROM ranked) WHERE rn=1",
    ("ranked",),
)
def _(t):
    return ranking.cohort_best(ranked(t)).select("cohort", "entity", "position_rank", "minutes")


CTE["best1"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY position_rank, minutes, entity) AS rn FROM ranked) WHERE rn=1"
CTE_DEPS["best1"] = ("ranked",)


@query(
    "K7_compare_to_best",
    """SELECT cohort, metric, entity, round(diff,6) AS direction_adjusted_difference, CASE WHEN diff>0 THEN 'centroid' WHEN diff<0 THEN 'best' ELSE 'tie' END AS leader FROM (
  SELECT c.cohort, c.metric, b.entity, round((c.mean-fl.value)*c.direction,9) AS diff FROM cent c JOIN best1 b ON c.cohort=b.cohort JOIN fl ON fl.entity=b.entity AND fl.cohort=b.cohort AND fl.metric=c.metric)""",
    ("cent", "best1", "fl"),
)
def _(t):
    from ..session import cut_lineage

    r = cut_lineage(ranked(t))
    m = metric_table(t)
    cent, _s = ranking.build_centroids(r, m)
    out = ranking.compare_to_best(cent, ranking.cohort_best(r), m)
    return out.select("cohort", "metric", "entity", F.round("direction_adjusted_difference", 6).alias("direction_adjusted_difference"), "leader")
