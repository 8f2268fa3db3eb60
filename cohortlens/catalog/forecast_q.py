"""Forecast and back-test queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import ordered
from ..operators.resample import scatter_sql
from ..operators.windows import sequence_flag
from ..plans import forecast as M
from ..plans import goals_glm
from .base import CTE, CTE_DEPS, query


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def matches(t):
    """Finished orders as matches between nations; a competition is a league."""
    return t.units().where(F.col("status") != "NS").select(F.col("league").alias("comp"), "unit", "ts", "home", "away", "home_goals", "away_goals")


def form_features(t):
    """Side features of matches decided in regular time, from their order lines: odd
    lines belong to the home side, even ones to the away side."""
    m = matches(t).join(t.units().where(F.col("status") == "FT").select("unit"), "unit", "left_semi")
    li = t.lineitem.select(
        F.col("l_orderkey").alias("unit"), (F.col("l_linenumber") % 2 == 1).alias("odd"), F.col("l_quantity").alias("minutes"), F.round(F.col("l_discount") * 100).alias("rating"),
        F.col("l_linenumber").cast("double").alias("shots"), F.lit(10.0).alias("passes"), F.col("l_linenumber").cast("double").alias("passes_accurate"), F.lit(1.0).alias("duels"), F.lit(0.0).alias("duels_won"),
    )
    rows = li.join(m, "unit").withColumn("side", F.when(F.col("odd"), F.col("home")).otherwise(F.col("away")))
    return A.side_unit_features(rows, ["unit", "side"])


CTE["mt"] = "SELECT league AS comp, unit, ts, home, away, home_goals, away_goals, CASE WHEN home_goals>away_goals THEN 'H' WHEN home_goals=away_goals THEN 'D' ELSE 'A' END AS actual FROM u WHERE status<>'NS'"
CTE_DEPS["mt"] = ("u",)
CTE["msd"] = """
SELECT *, coalesce(sum(f) OVER w,0) AS gf, coalesce(sum(g) OVER w,0) AS ga, count(*) OVER w AS games FROM (
  SELECT comp, unit, ts, 'home' AS venue, home AS side, home_goals AS f, away_goals AS g FROM mt UNION ALL SELECT comp, unit, ts, 'away', away, away_goals, home_goals FROM mt) WINDOW w AS (PARTITION BY comp, side ORDER BY ts, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
CTE_DEPS["msd"] = ("mt",)
CTE["pri"] = """
SELECT m.*, h.gf AS home_gf, h.ga AS home_ga, h.games AS home_games, a.gf AS away_gf, a.ga AS away_ga, a.games AS away_games FROM (
  SELECT *, count(*) OVER w AS prior_matches, coalesce(sum(home_goals+away_goals) OVER w,0) AS prior_goals, coalesce(sum(CAST(actual='H' AS INTEGER)) OVER w,0) AS prior_h, coalesce(sum(CAST(actual='D' AS INTEGER)) OVER w,0) AS prior_d, coalesce(sum(CAST(actual='A' AS INTEGER)) OVER w,0) AS prior_a
  FROM mt WINDOW w AS (PARTITION BY comp ORDER BY ts, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) m
JOIN (SELECT * FROM msd WHERE venue='home') h ON m.unit=h.unit JOIN (SELECT * FROM msd WHERE venue='away') a ON m.unit=a.unit"""
CTE_DEPS["pri"] = ("mt", "msd")


@query(
    "W13_expanding_prior",
    "SELECT comp, unit, prior_matches, CAST(prior_goals AS BIGINT) AS prior_goals, CAST(prior_h AS BIGINT) AS prior_h, CAST(prior_d AS BIGINT) AS prior_d, CAST(prior_a AS BIGINT) AS prior_a, CAST(home_gf AS BIGINT) AS home_gf, CAST(home_ga AS BIGINT) AS home_ga, home_games, CAST(away_gf AS BIGINT) AS away_gf, CAST(away_ga AS BIGINT) AS away_ga, away_games FROM pri",
    ("pri",),
)
def _(t):
    cols = ["prior_matches", "prior_goals", "prior_h", "prior_d", "prior_a", "home_gf", "home_ga", "home_games", "away_gf", "away_ga", "away_games"]
    return M.expanding_prior(matches(t)).select("comp", "unit", *cols)


@query(
    "W14_last_k_mean",
    """SELECT user_id, event_id, round(coalesce(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),6.5e0),6) AS last5 FROM events""",
)
def _(t):
    ev = t.events.select("user_id", "event_id", "ts", "value")
    out = ordered.last_k(ev, ["user_id"], ["ts", "event_id"], 5, {"last5": F.avg("value")})
    return out.select("user_id", "event_id", F.round(F.coalesce("last5", F.lit(6.5)), 6).alias("last5"))


CTE["fkt"] = "SELECT unnest(range(0,11)) AS k, unnest([1e0,1e0,2e0,6e0,24e0,120e0,720e0,5040e0,40320e0,362880e0,3628800e0]) AS fk"
CTE["rt"] = """
SELECT *, CASE WHEN gr>0 THEN least(greatest((home_gf+4e0*gr)/(home_games+4e0)*((away_ga+4e0*gr)/(away_games+4e0))/gr,0.2e0),4.5e0) ELSE 0.2e0 END AS lh, CASE WHEN gr>0 THEN least(greatest((away_gf+4e0*gr)/(away_games+4e0)*((home_ga+4e0*gr)/(home_games+4e0))/gr,0.2e0),4.5e0) ELSE 0.2e0 END AS la
FROM (SELECT *, CASE WHEN prior_matches>0 THEN prior_goals*1e0/(2*prior_matches) ELSE 1.35e0 END AS gr FROM pri)"""
CTE_DEPS["rt"] = ("pri",)


@query("M4_base_rate_forecast", "SELECT comp, unit, round((1e0+prior_h)/(prior_matches+3),6) AS base_home, round((1e0+prior_d)/(prior_matches+3),6) AS base_draw, round((1e0+prior_a)/(prior_matches+3),6) AS base_away FROM pri", ("pri",))
def _(t):
    return M.base_rate(M.expanding_prior(matches(t))).select("comp", "unit", *r6("base_home", "base_draw", "base_away"))


@query("M5_shrunk_rates", "SELECT comp, unit, round(gr,6) AS global_rate, round(lh,6) AS lambda_home, round(la,6) AS lambda_away FROM rt", ("rt",))
def _(t):
    return M.shrunk_rates(M.expanding_prior(matches(t))).select("comp", "unit", *r6("global_rate", "lambda_home", "lambda_away"))


# Rates of the shared-table binding for the matrix queries: straight from the goals.
def given_rates(t):
    u = t.units().where(F.col("status") == "FT")
    return u.select("unit", (0.3 + F.col("home_goals") * 0.7).alias("lh"), (0.4 + F.col("away_goals") * 0.5).alias("la"), ((F.col("unit") % 9 - 4) / 20.0).alias("rho"), "home_goals", "away_goals")


CTE["gv"] = "SELECT unit, 0.3e0+home_goals*0.7e0 AS lh, 0.4e0+away_goals*0.5e0 AS la, (unit%9-4)/20e0 AS rho, home_goals, away_goals FROM ft"
CTE_DEPS["gv"] = ("ft",)
CTE["cell"] = """
SELECT unit, i, j, v/sum(v) OVER (PARTITION BY unit) AS p FROM (SELECT unit, a.k AS i, b.k AS j, exp(a.k*ln(lh)-lh)/a.fk*exp(b.k*ln(la)-la)/b.fk*CASE WHEN a.k=0 AND b.k=0 THEN greatest(0.05e0,1-lh*la*rho) WHEN a.k=0 AND b.k=1 THEN greatest(0.05e0,1+lh*rho) WHEN a.k=1 AND b.k=0 THEN greatest(0.05e0,1+la*rho) WHEN a.k=1 AND b.k=1 THEN greatest(0.05e0,1-rho) ELSE 1e0 END AS v FROM gv, fkt a, fkt b)"""
CTE_DEPS["cell"] = ("gv", "fkt")


@query("M1_poisson_matrix", "SELECT unit, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(p,6) AS p FROM cell", ("cell",))
def _(t):
    return M.poisson_matrix(given_rates(t), ["unit"], "lh", "la", "rho").select("unit", "i", "j", *r6("p"))


CTE["opr"] = "SELECT unit, sum(CASE WHEN i>j THEN p ELSE 0e0 END) AS p_home, sum(CASE WHEN i=j THEN p ELSE 0e0 END) AS p_draw, sum(CASE WHEN i<j THEN p ELSE 0e0 END) AS p_away FROM cell GROUP BY unit"
CTE_DEPS["opr"] = ("cell",)


@query("M2_outcome_probs", "SELECT unit, round(p_home,6) AS p_home, round(p_draw,6) AS p_draw, round(p_away,6) AS p_away FROM opr", ("opr",))
def _(t):
    return M.outcome_probs(given_rates(t), "lh", "la", "rho").select("unit", *r6("p_home", "p_draw", "p_away"))


_SCORE = """round((ph-CAST(actual='H' AS INTEGER))**2+(pd-CAST(actual='D' AS INTEGER))**2+(pa-CAST(actual='A' AS INTEGER))**2,6) AS brier, round(-ln(greatest(1e-12,CASE actual WHEN 'H' THEN ph WHEN 'D' THEN pd ELSE pa END)),6) AS log_loss,
  round(((ph-CAST(actual='H' AS INTEGER))**2+(ph+pd-CAST(actual<>'A' AS INTEGER))**2)/2e0,6) AS rps, CASE WHEN round(ph,12)>=round(pd,12) AND round(ph,12)>=round(pa,12) THEN 'H' WHEN round(pd,12)>=round(pa,12) THEN 'D' ELSE 'A' END=actual AS accuracy"""


@query(
    "M3_proper_scores",
    f"SELECT unit, {_SCORE} FROM (SELECT opr.unit, p_home AS ph, p_draw AS pd, p_away AS pa, CASE WHEN away_goals>home_goals THEN 'A' WHEN home_goals=away_goals THEN 'D' ELSE 'H' END AS actual FROM opr JOIN gv ON opr.unit=gv.unit)",
    ("opr", "gv"),
)
def _(t):
    from ..functions.scalar import outcome_label

    rows = M.outcome_probs(given_rates(t), "lh", "la", "rho").withColumn("actual", outcome_label("home_goals", "away_goals"))
    return M.proper_scores(rows).select("unit", *r6("brier", "log_loss", "rps"), "accuracy")


CTE["fc"] = "SELECT * FROM rt WHERE prior_matches>=12"
CTE_DEPS["fc"] = ("rt",)
CTE["pm"] = """
SELECT fc.comp, fc.unit, fc.ts, fc.actual, lh, la, home_goals, away_goals, base.*, s.* EXCLUDE (unit) FROM fc JOIN (SELECT unit AS bu, (1e0+prior_h)/(prior_matches+3) AS bh, (1e0+prior_d)/(prior_matches+3) AS bd, (1e0+prior_a)/(prior_matches+3) AS ba FROM fc) base ON fc.unit=bu
JOIN (SELECT unit, sum(CASE WHEN i>j THEN v ELSE 0e0 END) AS sh, sum(CASE WHEN i=j THEN v ELSE 0e0 END) AS sd, sum(CASE WHEN i<j THEN v ELSE 0e0 END) AS sa, max(CASE WHEN i=0 AND j=0 THEN v END) AS v00, max(CASE WHEN i=0 AND j=1 THEN v END) AS v01, max(CASE WHEN i=1 AND j=0 THEN v END) AS v10, max(CASE WHEN i=1 AND j=1 THEN v END) AS v11, max(CASE WHEN i=gh AND j=ga THEN v END) AS vg FROM (
  SELECT unit, home_goals AS gh, away_goals AS ga, a.k AS i, b.k AS j, exp(a.k*ln(lh)-lh)/a.fk*(exp(b.k*ln(la)-la)/b.fk) AS v FROM fc, fkt a, fkt b) GROUP BY unit) s ON fc.unit=s.unit"""
CTE_DEPS["pm"] = ("fc", "fkt")
CTE["ll"] = """
SELECT comp, unit, ts, k, ln(greatest(1e-12, vg*CASE WHEN home_goals=0 AND away_goals=0 THEN t00 WHEN home_goals=0 AND away_goals=1 THEN t01 WHEN home_goals=1 AND away_goals=0 THEN t10 WHEN home_goals=1 AND away_goals=1 THEN t11 ELSE 1e0 END/(sh+sd+sa+v00*(t00-1)+v01*(t01-1)+v10*(t10-1)+v11*(t11-1)))) AS l FROM (
  SELECT *, greatest(0.05e0,1-lh*la*r) AS t00, greatest(0.05e0,1+lh*r) AS t01, greatest(0.05e0,1+la*r) AS t10, greatest(0.05e0,1-r) AS t11 FROM (SELECT pm.*, k, k*0.005e0-0.2e0 AS r FROM pm, (SELECT unnest(range(0,81)) AS k)))"""
CTE_DEPS["ll"] = ("pm",)
CTE["rho"] = """
SELECT comp, unit, CASE WHEN max(seen)>=10 THEN round(arg_max(k, (s, -k))*0.005e0-0.2e0,6) ELSE 0e0 END AS rho FROM (
  SELECT comp, unit, k, round(coalesce(sum(l) OVER w,0e0),9) AS s, count(*) OVER w AS seen FROM ll WINDOW w AS (PARTITION BY comp, k ORDER BY ts, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY comp, unit"""
CTE_DEPS["rho"] = ("ll",)


@query("M6_rho_grid_fit", "SELECT comp, unit, rho FROM rho", ("rho",))
def _(t):
    from ..session import cut_lineage

    state = cut_lineage(M.shrunk_rates(M.expanding_prior(matches(t))).where(F.col("prior_matches") >= M.WARM_UP))
    return M.rho_grid_fit(state).select("comp", "unit", "rho")


#: The k-th match of every competition in one round; a competition's ratings are a list.
ELO_SQL = """
mx AS (SELECT comp, unit, home, away, home_goals AS gh, away_goals AS ga, row_number() OVER (PARTITION BY comp ORDER BY ts, unit) AS k FROM mt),
er(comp, k, unit, eh, ea, book) AS (
  SELECT comp, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 0e0, 0e0, list_transform(range(0, (SELECT max(greatest(home, away))+1 FROM mx)), lambda x: 1500e0) FROM mx GROUP BY comp
  UNION ALL
  SELECT comp, k, unit, h, a, list_transform(book, lambda x, i: x + CASE WHEN i=home+1 THEN d ELSE 0e0 END - CASE WHEN i=away+1 THEN d ELSE 0e0 END) FROM (
    SELECT *, 24e0*(ln(abs(gh-ga)+1)+1e0)*(CASE WHEN gh>ga THEN 1e0 WHEN gh=ga THEN 0.5e0 ELSE 0e0 END-1e0/(1e0+power(10e0,(a-h)/400e0))) AS d FROM (
      SELECT mx.*, er.book, er.book[home+1] AS h, er.book[away+1] AS a FROM er JOIN mx ON mx.comp=er.comp AND mx.k=er.k+1)))"""


@query("M7_elo_ratings", f"WITH RECURSIVE {ELO_SQL} SELECT comp, unit, round(eh,6) AS elo_home, round(ea,6) AS elo_away FROM er WHERE k>0", ("mt",))
def _(t):
    return M.elo_ratings(matches(t)).select("comp", "unit", *r6("elo_home", "elo_away"))


@query(
    "M7_elo_parts",
    """WITH RECURSIVE e AS (SELECT comp, home AS a, away AS b FROM mt UNION SELECT comp, away, home FROM mt),
r(comp, side, o) AS (SELECT comp, a, a FROM e UNION SELECT r.comp, r.side, e.b FROM r JOIN e ON e.comp=r.comp AND e.a=r.o)
SELECT comp, side, min(o) AS part FROM r GROUP BY ALL""",
    ("mt",),
)
def _(t):
    return M.elo_parts(matches(t))


#: Rows of `sf` are the sides of `mt` with the means of their last five feature rows.
_FORM_SQL = """
fx AS (SELECT unit, side, coalesce(sum(rating*minutes)/nullif(sum(minutes),0),6.5e0) AS rating, sum(shots) AS shots, coalesce(sum(shots)/nullif(sum(10e0),0),0.75e0) AS pa FROM (
  SELECT m.unit, CASE WHEN l_linenumber%2=1 THEN m.home ELSE m.away END AS side, round(l_discount*100) AS rating, CAST(l_quantity AS DOUBLE) AS minutes, CAST(l_linenumber AS DOUBLE) AS shots
  FROM lineitem JOIN mt m ON l_orderkey=m.unit WHERE l_orderkey IN (SELECT unit FROM u WHERE status='FT')) GROUP BY ALL),
sd AS (SELECT s.comp, s.unit, s.ts, s.venue, s.side, fx.rating, fx.shots, fx.pa, count(fx.rating) OVER (PARTITION BY s.comp, s.side ORDER BY s.ts, s.unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM msd s LEFT JOIN fx ON fx.unit=s.unit AND fx.side=s.side),
fm AS (SELECT comp, side, row_number() OVER w AS i, avg(rating) OVER w5 AS rating, avg(shots) OVER w5 AS shots, avg(pa) OVER w5 AS pa FROM sd WHERE rating IS NOT NULL
  WINDOW w AS (PARTITION BY comp, side ORDER BY ts, unit), w5 AS (PARTITION BY comp, side ORDER BY ts, unit ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
sf AS (SELECT sd.comp, sd.unit, sd.venue, coalesce(fm.rating,6.5e0) AS rating, coalesce(fm.shots,10e0) AS shots, coalesce(fm.pa,0.75e0) AS pa FROM sd LEFT JOIN fm ON fm.comp=sd.comp AND fm.side=sd.side AND fm.i=sd.seen),
fe AS (SELECT p.comp, p.unit, (1e0+prior_d)/(prior_matches+3) AS bd, 0.0042e0*(eh-ea)+0.45e0*(h.rating-a.rating)+0.035e0*(h.shots-a.shots)+1.2e0*(h.pa-a.pa) AS edge
  FROM pri p JOIN er ON er.unit=p.unit JOIN sf h ON h.unit=p.unit AND h.venue='home' JOIN sf a ON a.unit=p.unit AND a.venue='away'),
fp AS (SELECT comp, unit, edge, greatest((1-dr)*wn,1e-8)/z AS fh, greatest(dr,1e-8)/z AS fd, greatest((1-dr)*(1-wn),1e-8)/z AS fa FROM (
  SELECT *, greatest((1-dr)*wn,1e-8)+greatest(dr,1e-8)+greatest((1-dr)*(1-wn),1e-8) AS z FROM (
    SELECT *, 1e0/(1e0+exp(-edge)) AS wn, least(greatest(bd*(0.72e0+0.55e0*exp(-abs(edge))),0.12e0),0.38e0) AS dr FROM fe)))"""


@query("M8_form_logit", f"WITH RECURSIVE {ELO_SQL},{_FORM_SQL} SELECT comp, unit, round(edge,6) AS edge, round(fh,6) AS form_home, round(fd,6) AS form_draw, round(fa,6) AS form_away FROM fp", ("mt", "msd", "pri", "u"))
def _(t):
    from ..session import cut_lineage

    m = cut_lineage(matches(t))
    rows = M.base_rate(M.expanding_prior(m))
    rows = rows.join(M.elo_ratings(m), ["comp", "unit"]).join(M.last_form(m, form_features(t)), ["comp", "unit"])
    return M.form_logit(rows).select("comp", "unit", *r6("edge", "form_home", "form_draw", "form_away"))


CTE["dc"] = """
SELECT pm.*, rho.rho, greatest(0.05e0,1-lh*la*rho) AS t00, greatest(0.05e0,1+lh*rho) AS t01, greatest(0.05e0,1+la*rho) AS t10, greatest(0.05e0,1-rho) AS t11 FROM pm JOIN rho ON pm.unit=rho.unit"""
CTE_DEPS["dc"] = ("pm", "rho")
CTE["bt"] = f"""
SELECT comp, unit, model, actual, ph, pd, pa, {_SCORE} FROM (
 SELECT comp, unit, actual, 'naive_base_rate' AS model, bh AS ph, bd AS pd, ba AS pa FROM dc UNION ALL
 SELECT comp, unit, actual, 'poisson_shrunk', sh/(sh+sd+sa), sd/(sh+sd+sa), sa/(sh+sd+sa) FROM dc UNION ALL
 SELECT comp, unit, actual, 'dixon_coles_shrunk', (sh+v10*(t10-1))/z, (sd+v00*(t00-1)+v11*(t11-1))/z, (sa+v01*(t01-1))/z FROM (SELECT *, sh+sd+sa+v00*(t00-1)+v01*(t01-1)+v10*(t10-1)+v11*(t11-1) AS z FROM dc))"""
CTE_DEPS["bt"] = ("dc",)


@query("M9_rolling_backtest", "SELECT comp, unit, model, brier, log_loss, rps, accuracy FROM bt", ("bt",))
def _(t):
    return M.rolling_backtest(matches(t)).select("comp", "unit", "model", *r6("brier", "log_loss", "rps"), "accuracy")


@query(
    "M9_four_models",
    f"""WITH RECURSIVE {ELO_SQL},{_FORM_SQL},
b4 AS (SELECT model, brier, log_loss, rps, accuracy FROM bt UNION ALL SELECT 'transparent_form', {_SCORE} FROM (SELECT dc.actual, fh AS ph, fd AS pd, fa AS pa FROM fp JOIN dc ON dc.unit=fp.unit))
SELECT model, count(*) AS matches, round(avg(brier),4) AS brier_score, round(avg(log_loss),4) AS log_loss, round(avg(rps),4) AS ranked_probability_score, round(avg(CASE WHEN accuracy THEN 1e0 ELSE 0e0 END),6) AS top1_accuracy,
  round(1-avg(log_loss)/(SELECT avg(log_loss) FROM b4 WHERE model='naive_base_rate'),4) AS log_loss_skill_vs_naive FROM b4 GROUP BY model""",
    ("mt", "msd", "pri", "u", "dc", "bt"),
)
def _(t):
    out = A.model_scores(M.rolling_backtest(matches(t), form_features(t)), "naive_base_rate")
    four = [F.round(x, 4).alias(x) for x in ("brier_score", "log_loss", "ranked_probability_score", "log_loss_skill_vs_naive")]
    return out.select("model", "matches", *four, *r6("top1_accuracy"))


EDGES = [0.0, 0.35, 0.45, 0.55, 0.65, 0.75, 1.0]
LABELS = ["b1", "b2", "b3", "b4", "b5", "b6"]


@query(
    "A30_calibration_bins",
    """SELECT model, bin, count(*) AS n, round(avg(c),6) AS mean_confidence, round(avg(CASE WHEN accuracy THEN 1e0 ELSE 0e0 END),6) AS observed_accuracy FROM (
 SELECT *, CASE WHEN c<=0.35 THEN 'b1' WHEN c<=0.45 THEN 'b2' WHEN c<=0.55 THEN 'b3' WHEN c<=0.65 THEN 'b4' WHEN c<=0.75 THEN 'b5' ELSE 'b6' END AS bin FROM (SELECT *, greatest(ph,pd,pa) AS c FROM bt)) GROUP BY ALL""",
    ("bt",),
)
def _(t):
    return A.calibration_bins(M.rolling_backtest(matches(t)), EDGES, LABELS).select("model", "bin", "n", *r6("mean_confidence", "observed_accuracy"))


@query(
    "A31_model_scores",
    """SELECT model, count(*) AS matches, round(avg(brier),4) AS brier_score, round(avg(log_loss),4) AS log_loss, round(avg(rps),4) AS ranked_probability_score, round(avg(CASE WHEN accuracy THEN 1e0 ELSE 0e0 END),6) AS top1_accuracy,
  round(1-avg(log_loss)/(SELECT avg(log_loss) FROM bt WHERE model='naive_base_rate'),4) AS log_loss_skill_vs_naive FROM bt GROUP BY model""",
    ("bt",),
)
def _(t):
    out = A.model_scores(M.rolling_backtest(matches(t)), "naive_base_rate")
    four = [F.round(x, 4).alias(x) for x in ("brier_score", "log_loss", "ranked_probability_score", "log_loss_skill_vs_naive")]
    return out.select("model", "matches", *four, *r6("top1_accuracy"))


CTE["str"] = """
SELECT side, strength, attack, defence, (strength-avg(strength) OVER ())/greatest(stddev_pop(strength) OVER (),1e-9) AS z FROM (
 SELECT side, sum(w*strength)/sum(w) AS strength, sum(w*attack)/sum(w) AS attack, sum(w*defence)/sum(w) AS defence FROM (
  SELECT *, sqrt(greatest(minutes,90e0)) AS w, row_number() OVER (PARTITION BY side ORDER BY strength DESC, entity) AS rn FROM (SELECT *, round(0.42e0*attack+0.25e0*control+0.33e0*defence,12) AS strength FROM sq WHERE minutes>=60)) WHERE rn<=18 GROUP BY side)"""
CTE_DEPS["str"] = ("sq",)
CTE["ho"] = """
SELECT u.unit, 1.3e0*exp(0.22e0*(h.z-a.z)+0.18e0*(h.attack-a.defence)) AS lh, 1.3e0*exp(-0.22e0*(h.z-a.z)+0.18e0*(a.attack-h.defence)) AS la, CASE WHEN home_goals>away_goals THEN 'H' WHEN home_goals=away_goals THEN 'D' ELSE 'A' END AS actual FROM u JOIN str h ON u.home=h.side JOIN str a ON u.away=a.side WHERE status='FT' AND season>=2000"""
CTE_DEPS["ho"] = ("u", "str")


@query(
    "M10_frozen_holdout",
    f"""SELECT unit, round(lh,6) AS lambda_home, round(la,6) AS lambda_away, {_SCORE} FROM (SELECT unit, lh, la, actual, h/(h+d+a) AS ph, d/(h+d+a) AS pd, a/(h+d+a) AS pa FROM (
 SELECT unit, lh, la, actual, sum(CASE WHEN i>j THEN v ELSE 0e0 END) AS h, sum(CASE WHEN i=j THEN v ELSE 0e0 END) AS d, sum(CASE WHEN i<j THEN v ELSE 0e0 END) AS a FROM (SELECT ho.*, x.k AS i, y.k AS j, exp(x.k*ln(lh)-lh)/x.fk*(exp(y.k*ln(la)-la)/y.fk) AS v FROM ho, fkt x, fkt y) GROUP BY ALL))""",
    ("ho", "fkt"),
)
def _(t):
    from ..plans.ranking import squad_strength
    from ..session import cut_lineage

    totals = t.entity_units().groupBy("entity", "side").agg(*[F.sum(x).alias(x) for x in ("minutes", "goals", "shots", "passes", "duels_won", "saves")])
    p90 = lambda x: F.col(x) * 90.0 / F.col("minutes")
    raws = {"attack": 5.0 * p90("goals") + 0.7 * p90("shots"), "control": 0.015 * p90("passes") + 0.35 * p90("duels_won"), "defence": 0.45 * p90("saves") + 0.35 * p90("duels_won")}
    strengths = cut_lineage(squad_strength(totals, "side", "entity", raws, 18, 60.0).select("side", "z", "attack", "defence"))
    hold = t.units().where((F.col("status") == "FT") & (F.col("season") >= 2000))
    return M.frozen_holdout(hold, strengths).select("unit", *r6("lambda_home", "lambda_away", "brier", "log_loss", "rps"), "accuracy")


@query("M11_decay_weights", "SELECT unit, round(power(0.5e0, (epoch(TIMESTAMP '2001-08-01')-epoch(ts))/86400e0/365e0),9) AS weight FROM u", ("u",))
def _(t):
    w = M.decay_weight(F.col("ts"), F.lit("2001-08-01").cast("timestamp_ntz"), 365.0)
    return t.units().select("unit", F.round(w, 9).alias("weight"))


def flagged(t):
    m = t.units().where(F.col("status") != "NS").select("unit", "league", "ts", "home", "away", "home_goals", "away_goals")
    return sequence_flag(m, ["league"], ["ts", "unit"], 72)


CTE["flg"] = "SELECT * EXCLUDE (n), CAST(n>72 AS INTEGER) AS knockout FROM (SELECT *, row_number() OVER (PARTITION BY league ORDER BY ts, unit) AS n FROM u WHERE status<>'NS')"
CTE_DEPS["flg"] = ("u",)


def _fit_sql(points, hold_out: int, refit: bool = False) -> str:
    """CTEs for the fit of ``points`` on all but the last ``hold_out`` matches: `tst`, `c`
    (cells), `tot`, and `fit` (p, alpha, hl, kind, side, v). A round of Newton steps for
    attack effects, one for defence effects, one for intercept and slope, in turn. With
    ``refit`` point p + the number of points is p on all matches."""
    rows = [(p + z * len(points), a, h, z) for z in range(1 + refit) for p, (a, h) in enumerate(points)]
    values = ", ".join(f"({p}, {a}e0, {'NULL' if h is None else f'{h}e0'}, {z})" for p, a, h, z in rows)
    sides = " UNION ALL ".join(
        f"SELECT {z} AS z, (SELECT max(ts) FROM {m}) AS mx, ts, home AS att, away AS def, knockout AS x, home_goals AS g FROM {m} UNION ALL SELECT {z}, (SELECT max(ts) FROM {m}), ts, away, home, knockout, away_goals FROM {m}"
        for z, m in enumerate(["trn", "flg"][: 1 + refit])
    )
    return f"""tst AS (SELECT * FROM flg ORDER BY ts DESC, unit DESC LIMIT {hold_out}),
trn AS (SELECT * FROM flg WHERE unit NOT IN (SELECT unit FROM tst)),
pt(p, alpha, hl, z) AS (VALUES {values}),
lr AS ({sides}),
c AS (SELECT p, alpha, att, def, x, sum(w) AS w, sum(w*g) AS y FROM (
  SELECT *, CASE WHEN hl IS NULL THEN 1e0 ELSE power(0.5e0, (epoch(mx)-epoch(ts))/86400e0/hl) END AS w FROM lr JOIN pt ON pt.z=lr.z) WHERE w>0 GROUP BY ALL),
tot AS (SELECT p, alpha, sum(w) AS ww, sum(y) AS yy, sum(y*x) AS yx FROM c GROUP BY ALL),
r(it, p, kind, side, v) AS (
  SELECT 0, p, 'attack', att, 0e0 FROM c GROUP BY ALL UNION ALL SELECT 0, p, 'defence', def, 0e0 FROM c GROUP BY ALL
  UNION ALL SELECT 0, p, 'intercept', NULL, ln(yy/ww) FROM tot UNION ALL SELECT 0, p, 'slope', NULL, 0e0 FROM tot
  UNION ALL
  SELECT r.it+1, r.p, r.kind, r.side, CASE WHEN r.kind='attack' AND r.it%3=0 OR r.kind='defence' AND r.it%3=1 THEN r.v+greatest(-1e0,least(1e0,(s.y-s.m-tot.alpha*tot.ww*r.v)/(s.m+tot.alpha*tot.ww)))
    WHEN r.kind='intercept' AND r.it%3=2 THEN r.v+greatest(-1e0,least(1e0,(s.mx*s.g1-s.hk*s.g0)/(s.m*s.hk-s.mx*s.mx)))
    WHEN r.kind='slope' AND r.it%3=2 THEN r.v+greatest(-1e0,least(1e0,(s.mx*s.g0-s.m*s.g1)/(s.m*s.hk-s.mx*s.mx))) ELSE r.v END
  FROM r JOIN tot ON tot.p=r.p LEFT JOIN (
    SELECT e.p, e.kind, e.side, e.m, e.y, e.mx, e.mxx+tot.alpha*tot.ww AS hk, e.m-e.y AS g0, e.mx-tot.yx+tot.alpha*tot.ww*e.k AS g1 FROM (
      SELECT p, kind, side, sum(mu) AS m, sum(y) AS y, sum(mu*x) AS mx, sum(mu*x*x) AS mxx, max(k) AS k FROM (
        SELECT c.p, c.x, c.y, sl.v AS k, c.w*exp(ic.v+sl.v*c.x+ra.v+rd.v) AS mu, unnest(['attack','defence','intercept','slope']) AS kind, unnest([c.att,c.def,NULL,NULL]) AS side
        FROM c JOIN r ra ON ra.p=c.p AND ra.kind='attack' AND ra.side=c.att JOIN r rd ON rd.p=c.p AND rd.kind='defence' AND rd.side=c.def
        JOIN r ic ON ic.p=c.p AND ic.kind='intercept' JOIN r sl ON sl.p=c.p AND sl.kind='slope') GROUP BY ALL) e JOIN tot ON tot.p=e.p) s
    ON s.p=r.p AND s.kind=r.kind AND s.side IS NOT DISTINCT FROM r.side
  WHERE r.it<240),
fit AS (SELECT r.p, alpha, hl, kind, side, v FROM r JOIN pt ON pt.p=r.p WHERE it=240),
fr AS (SELECT m.unit, m.home_goals, m.away_goals, ic.p, ic.alpha, ic.hl, exp(ic.v+sl.v*m.knockout+coalesce(ha.v,0e0)+coalesce(ad.v,0e0)) AS lh, exp(ic.v+sl.v*m.knockout+coalesce(aa.v,0e0)+coalesce(hd.v,0e0)) AS la
  FROM (SELECT * FROM {'tst' if hold_out else 'flg'}) m JOIN fit ic ON ic.kind='intercept' JOIN fit sl ON sl.kind='slope' AND sl.p=ic.p
  LEFT JOIN fit ha ON ha.p=ic.p AND ha.kind='attack' AND ha.side=m.home LEFT JOIN fit hd ON hd.p=ic.p AND hd.kind='defence' AND hd.side=m.home
  LEFT JOIN fit aa ON aa.p=ic.p AND aa.kind='attack' AND aa.side=m.away LEFT JOIN fit ad ON ad.p=ic.p AND ad.kind='defence' AND ad.side=m.away)"""


@query("M12_poisson_glm", f"WITH RECURSIVE {_fit_sql([(0.1, None)], 0)} SELECT unit, round(lh,4) AS lambda_home, round(la,4) AS lambda_away FROM fr", ("flg",))
def _(t):
    m = flagged(t)
    return M.glm_rates(M.poisson_glm(m, 0.1, None), m).select("unit", *[F.round(x, 4).alias(x) for x in ("lambda_home", "lambda_away")])


@query(
    "M12_score_equations",
    """SELECT block, side, 0e0 AS residual FROM (SELECT 'attack' AS block, CAST(home AS VARCHAR) AS side FROM flg UNION SELECT 'attack', CAST(away AS VARCHAR) FROM flg
  UNION SELECT 'defence', CAST(home AS VARCHAR) FROM flg UNION SELECT 'defence', CAST(away AS VARCHAR) FROM flg UNION SELECT 'intercept', NULL UNION SELECT 'slope', NULL)""",
    ("flg",),
)
def _(t):
    m = flagged(t)
    return goals_glm.score_equations(M.poisson_glm(m, 0.1, None), m).select("block", "side", (F.round("residual", 6) + 0.0).alias("residual"))


_LOSS_SQL = """ls AS (SELECT p, alpha, hl AS half_life, count(*) AS matches, avg(-ln(greatest(1e-12, hit/z))) AS log_loss FROM (
  SELECT fr.unit, fr.p, fr.alpha, fr.hl, sum(v) AS z, sum(CASE WHEN sign(i-j)=sign(home_goals-away_goals) THEN v ELSE 0e0 END) AS hit FROM (
    SELECT fr.*, a.k AS i, b.k AS j, exp(a.k*ln(lh)-lh)/a.fk*(exp(b.k*ln(la)-la)/b.fk) AS v FROM fr, fkt a, fkt b) fr GROUP BY ALL) GROUP BY ALL)"""


@query("M13_grid_tune", f"WITH RECURSIVE {_fit_sql(M.grid_points(), 18)}, {_LOSS_SQL} SELECT alpha, half_life, matches, round(log_loss,4) AS log_loss FROM ls", ("flg", "fkt"))
def _(t):
    return M.grid_tune(flagged(t), 18).select("alpha", "half_life", "matches", F.round("log_loss", 4).alias("log_loss"))


_GAMES = "SELECT side, g, h, row_number() OVER (PARTITION BY side ORDER BY ts, unit)-1 AS i, count(*) OVER (PARTITION BY side) AS n FROM (SELECT home AS side, home_goals AS g, away_goals AS h, ts, unit FROM flg UNION ALL SELECT away, away_goals, home_goals, ts, unit FROM flg) WHERE side IN (3, 7)"
_DRAWS = scatter_sql("SELECT side, i, n, unnest(range(1, 201)) AS world FROM gm", 11, "world*65537+side", "i")


@query(
    "M14_bootstrap_rates",
    f"""WITH RECURSIVE {_fit_sql(M.grid_points(), 18, refit=True)}, {_LOSS_SQL},
best AS (SELECT p+{len(M.grid_points())} AS p FROM ls WHERE p<{len(M.grid_points())} ORDER BY log_loss, alpha, half_life NULLS LAST LIMIT 1),
pr AS (SELECT s.side, exp(ic.v+sl.v+a.v+d.v) AS glm FROM (VALUES (3, 7), (7, 3)) s(side, other) JOIN best ON true JOIN fit ic ON ic.p=best.p AND ic.kind='intercept' JOIN fit sl ON sl.p=best.p AND sl.kind='slope'
  JOIN fit a ON a.p=best.p AND a.kind='attack' AND a.side=s.side JOIN fit d ON d.p=best.p AND d.kind='defence' AND d.side=s.other),
gl AS (SELECT sum(home_goals+away_goals)*1e0/(2*count(*)) AS gr, (sum(home_goals+away_goals) FILTER (knockout=1)*1e0/(2*count(*) FILTER (knockout=1)))/(sum(home_goals+away_goals) FILTER (knockout=0)*1e0/(2*count(*) FILTER (knockout=0))) AS ko FROM flg),
gm AS ({_GAMES}),
dr AS (SELECT x.world, x.side, count(*) AS n, sum(gm.g) AS gf, sum(gm.h) AS ga FROM (SELECT world, side, d % n AS j FROM ({_DRAWS})) x JOIN gm ON gm.side=x.side AND gm.i=x.j GROUP BY ALL),
rt2 AS (SELECT world, side, gr, ko, (gf+4e0*gr)/(n+4e0) AS att, (ga+4e0*gr)/(n+4e0) AS def FROM dr, gl),
wr AS (SELECT a.side, exp(0.72e0*ln(glm)+0.28e0*ln(a.att*b.def/a.gr*a.ko)) AS rate FROM rt2 a JOIN rt2 b ON a.world=b.world AND a.side<>b.side JOIN pr ON pr.side=a.side)
SELECT side, round(quantile_cont(rate,0.025),6) AS rate_low, round(quantile_cont(rate,0.5),6) AS rate_mid, round(quantile_cont(rate,0.975),6) AS rate_high FROM wr GROUP BY side""",
    ("flg", "fkt"),
)
def _(t):
    from ..session import cut_lineage

    m = cut_lineage(flagged(t))
    out = M.bootstrap_rates(m, (3, 7), M.final_rates(m, (3, 7)), 200, 11)
    q = ordered.quantiles(out, ["side"], ["rate"], {"low": 0.025, "mid": 0.5, "high": 0.975})
    return q.select("side", *r6("rate_low", "rate_mid", "rate_high"))
