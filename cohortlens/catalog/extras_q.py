"""Second results of operators: class counts, decisions, summaries, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as P
from ..operators.tables import literal_table
from ..plans import forecast as M
from ..plans import ranking
from ..plans import selection as S
from .base import REGISTRY, query
from .selection_q import candidates
from .windows_q import metric_table, ranked


def _body(name: str) -> str:
    """The SQL twin of another query without its CTEs, as a subquery."""
    return f"({REGISTRY[name].body})"


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query(
    "A13_rate_classes",
    """SELECT count(*) FILTER (r=0) AS zero, count(*) FILTER (r>0 AND r<1) AS partial, count(*) FILTER (r=1) AS full
FROM (SELECT league, season, home%3 AS part, count(*) FILTER (status='FT')*1e0/count(*) AS r FROM u GROUP BY ALL)""",
    ("u",),
)
def _(t):
    rates = A.endpoint_rates(t.units().withColumn("part", F.col("home") % 3), ["league", "season", "part"], {"stats": F.col("status") == "FT"})
    return A.rate_classes(rates, "stats_rate").select("zero", "partial", "full")


@query(
    "A37_gate_decision",
    f"""SELECT bool_and(passed) AS passed, coalesce(string_agg(CASE WHEN NOT passed THEN metric END, ',' ORDER BY metric), '') AS blocking FROM {_body("A37_gate_table")}""",
    ("u",),
)
def _(t):
    return A.gate_decision(REGISTRY["A37_gate_table"].build(t))


@query(
    "P5_window_ranges",
    """SELECT unit, w AS "window" FROM u, (VALUES ('early', DATE '1992-01-01', DATE '1995-06-30'), ('late', DATE '1995-01-01', DATE '1998-12-31')) r(w, a, b)
WHERE CAST(ts AS DATE) BETWEEN a AND b""",
    ("u",),
)
def _(t):
    ranges = {"early": ("1992-01-01", "1995-06-30"), "late": ("1995-01-01", "1998-12-31")}
    return P.window_ranges(t.units().select("unit", "ts"), "ts", ranges).select("unit", "window")


@query(
    "K5_summary",
    """SELECT p.cohort, actual_n, round(mean_rank_score,6) AS mean_rank_score, round(median_minutes,6) AS median_minutes, eligible_pool_n, actual_n>=20 AS sample_complete FROM (
  SELECT cohort, count(*) AS actual_n, avg(rank_score) AS mean_rank_score, median(minutes) AS median_minutes FROM top20 GROUP BY cohort) s
JOIN (SELECT cohort, count(*) AS eligible_pool_n FROM ranked GROUP BY cohort) p ON s.cohort=p.cohort""",
    ("ranked", "top20"),
)
def _(t):
    _cent, summary = ranking.build_centroids(ranked(t), metric_table(t))
    return summary.select("cohort", "actual_n", *r6("mean_rank_score", "median_minutes"), "eligible_pool_n", "sample_complete")


@query(
    "K22_overall_gate",
    """SELECT bool_and(passed) AS passed, count(*) FILTER (passed) AS roles_passed, count(*) AS roles, coalesce(string_agg(CASE WHEN NOT passed THEN role END, ',' ORDER BY role), '') AS failing FROM (
  SELECT s.role, coalesce(g.passed, false) AS passed FROM (SELECT DISTINCT role FROM cand UNION SELECT 'NONE') s LEFT JOIN sgate g ON s.role=g.role)""",
    ("cand", "sgate"),
)
def _(t):
    c = candidates(t)
    spine = c.select("role").distinct().union(literal_table(t.spark, [("role", "string")], [("NONE",)]))
    return S.overall_gate(S.selection_sufficiency(c, spine)[1])


@query(
    "M10_holdout_summary",
    f"""SELECT count(*) AS matches, round(avg(brier),5) AS brier_score, round(avg(log_loss),5) AS log_loss, round(avg(rps),5) AS ranked_probability_score,
  round(avg(CASE WHEN accuracy THEN 1e0 ELSE 0e0 END),6) AS top1_accuracy, round(ln(3e0),5) AS naive_log_loss, round(1-avg(log_loss)/ln(3e0),5) AS skill FROM {_body("M10_frozen_holdout")}""",
    ("ho", "fkt"),
)
def _(t):
    rows = REGISTRY["M10_frozen_holdout"].build(t).withColumn("naive_log_loss", F.lit(-1.0) * F.log(F.lit(1.0 / 3.0)))
    five = lambda c: F.round(c, 5).alias(c)
    return M.holdout_summary(rows).select("matches", *map(five, ("brier_score", "log_loss", "ranked_probability_score")), *r6("top1_accuracy"), five("naive_log_loss"), five("skill"))
