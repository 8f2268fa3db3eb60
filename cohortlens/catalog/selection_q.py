"""Selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import ranking
from ..plans import selection as S
from ..presets.football import ROLE_WEIGHTS
from .base import CTE, CTE_DEPS, query
from .coverage_q import ledger
from .roles_q import DIMS, with_roles


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def candidates(t):
    """Scored profiles with evidence counts and window passes; some unscored, some
    without uncertainty."""
    p = ranking.score_profiles(with_roles(t), "role", ROLE_WEIGHTS)
    e = F.col("entity")
    overall = F.when(e % 23 != 0, F.round("overall", 9))
    return p.select(
        "entity", "role", "minutes", overall.alias("overall"), F.when(e % 17 != 0, F.col("uncertainty")).alias("uncertainty"),
        F.round(overall - F.col("uncertainty"), 9).alias("conservative_score"), (F.col("shots").cast("int") % 9).alias("role_observations"),
        (0.5 + (e % 50) / 100.0).alias("role_stability"), (e % 4 != 0).alias("pass_current"), (e % 7 != 0).alias("pass_pre"),
        F.when(e % 3 == 0, F.col("minutes") / 4).otherwise(0.0).alias("missing_minutes"), *[F.col(d) for d in DIMS],
    )


def _overall_sql() -> str:
    parts = []
    for role, ws in ROLE_WEIGHTS.items():
        terms = " + ".join(f"{w!r}e0*{'0.5e0' if d == 'base' else ('duels_dim' if d == 'duels' else d)}" for d, w in ws.items())
        parts.append(f"WHEN '{role}' THEN {terms}")
    return "CASE role " + " ".join(parts) + " END"


CTE["cand"] = f"""
SELECT entity, role, minutes, overall, CASE WHEN entity%17<>0 THEN uncertainty END AS uncertainty, round(overall-uncertainty,9) AS conservative_score, CAST(shots AS INTEGER)%9 AS role_observations, 0.5e0+(entity%50)/100e0 AS role_stability,
  entity%4<>0 AS pass_current, entity%7<>0 AS pass_pre, CASE WHEN entity%3=0 THEN minutes/4 ELSE 0e0 END AS missing_minutes, {", ".join(DIMS)}
FROM (SELECT *, CASE WHEN entity%23<>0 THEN round({_overall_sql()},9) END AS overall FROM prole)"""
CTE_DEPS["cand"] = ("prole",)
CTE["front"] = """
SELECT *, CASE WHEN weak THEN 'insufficient_evidence_guardrail' WHEN pb THEN 'plausible_real_xi' WHEN p30 THEN 'plausible_top30' ELSE 'top35_guardrail' END AS reason FROM (
 SELECT *, coalesce(coalesce(hi,1e0)>=kth,false) AS p30, coalesce(coalesce(hi,1e0)>=best,false) AS pb, coalesce(role_rank<=35,false) AS g35, overall IS NULL OR role_observations<3 OR role_stability<0.6 AS weak FROM (
  SELECT b.*, r.role_rank, k.kth, k.best FROM b LEFT JOIN (SELECT entity, row_number() OVER (PARTITION BY role ORDER BY conservative_score DESC, minutes DESC, entity) AS role_rank FROM b WHERE overall IS NOT NULL) r ON b.entity=r.entity
  LEFT JOIN (SELECT role, min(lo) AS kth, max(lo) AS best FROM (SELECT role, lo, row_number() OVER (PARTITION BY role ORDER BY lo DESC, entity) AS rn FROM b WHERE overall IS NOT NULL) WHERE rn<=30 GROUP BY role) k ON b.role=k.role))"""
CTE["b"] = """
SELECT entity, role, minutes, overall, unc, conservative_score, role_observations, role_stability, CASE WHEN overall IS NOT NULL THEN least(greatest(round(overall-1.96e0*unc,12),0e0),1e0) END AS lo, CASE WHEN overall IS NOT NULL THEN least(greatest(round(overall+1.96e0*unc,12),0e0),1e0) END AS hi
FROM (SELECT *, least(greatest(coalesce(uncertainty,0.25e0),0.025e0),0.35e0) AS unc FROM cand)"""
CTE_DEPS["b"] = ("cand",)
CTE_DEPS["front"] = ("b",)


@query(
    "K21_selection_frontier",
    "SELECT entity, role, role_rank, round(lo,6) AS lower_95, round(hi,6) AS upper_95, round(kth,6) AS top30_lower_threshold, round(best,6) AS best_lower_threshold, p30 AS plausible_top30, pb AS plausible_best, g35 AS guardrail_top35, weak AS weak_evidence, p30 OR pb OR g35 OR weak AS in_frontier, reason FROM front",
    ("front",),
)
def _(t):
    out = S.selection_frontier(candidates(t))
    return out.select(
        "entity", "role", "role_rank", *r6("lower_95", "upper_95", "top30_lower_threshold", "best_lower_threshold"), "plausible_top30", "plausible_best", "guardrail_top35", "weak_evidence", "in_frontier", "reason"
    )


CTE["s0"] = f"""
SELECT *, row_number() OVER (PARTITION BY role ORDER BY conservative_score DESC NULLS LAST, minutes DESC, entity) AS rank, row_number() OVER (PARTITION BY role ORDER BY hi90 DESC NULLS LAST, minutes DESC, entity) AS urank FROM (
 SELECT *, pass_current AND pass_pre AS covered, role_stability>=0.6 AND role_observations>=3 AND overall IS NOT NULL AS stable, CASE WHEN overall IS NOT NULL THEN least(greatest(round(overall-{S.Z90!r}e0*unc,12),0e0),1e0) END AS lo90,
  CASE WHEN overall IS NOT NULL THEN least(greatest(round(overall+{S.Z90!r}e0*unc,12),0e0),1e0) END AS hi90 FROM (SELECT *, least(greatest(coalesce(uncertainty,0.25e0),0.025e0),0.35e0) AS unc FROM cand))"""
CTE_DEPS["s0"] = ("cand",)
CTE["srole"] = """
SELECT z.*, least(30,stable_n) AS required, covered_n>=least(30,stable_n) AND stable_n>0 AS enabled, coalesce((SELECT max(lo90) FROM sbest s WHERE s.role=z.role AND s.k=least(30,z.stable_n)),-1e0) AS t30, coalesce((SELECT max(lo90) FROM sbest s WHERE s.role=z.role),-1e0) AS tb FROM (
  SELECT role, count(*) AS eligible, count(*) FILTER (stable) AS stable_n, count(*) FILTER (stable AND covered) AS covered_n FROM s0 GROUP BY role) z"""
CTE["sbest"] = "SELECT role, lo90, row_number() OVER (PARTITION BY role ORDER BY lo90 DESC, entity) AS k FROM s0 WHERE stable AND covered"
CTE_DEPS["sbest"] = ("s0",)
CTE_DEPS["srole"] = ("s0", "sbest")
CTE["suff"] = """
SELECT *, CASE WHEN covered THEN 'outside_decision_frontier' WHEN NOT stable AND (urank<=15 OR rank<=15) THEN 'high_ability_role_stabilization' WHEN stable AND covered_n>0 AND coalesce(hi90,1e0)>=tb THEN 'upper90_can_enter_real_xi'
  WHEN stable AND enabled AND coalesce(hi90,1e0)>=t30 THEN 'upper90_can_enter_top30' WHEN NOT enabled AND un<=greatest(required-covered_n,5) THEN 'covered_pool_shortage' WHEN stable AND rank<=required+5 THEN 'top35_guardrail' ELSE 'outside_decision_frontier' END AS reason
FROM (SELECT s0.*, r.required, r.enabled, r.covered_n, r.t30, r.tb, row_number() OVER (PARTITION BY s0.role, covered ORDER BY rank) AS un FROM s0 JOIN srole r ON s0.role=r.role)"""
CTE_DEPS["suff"] = ("s0", "srole")


@query(
    "K22_selection_sufficiency",
    "SELECT entity, role, rank, urank, round(lo90,6) AS lo90, round(hi90,6) AS hi90, covered, stable, reason, reason<>'outside_decision_frontier' AS needed FROM suff",
    ("suff",),
)
def _(t):
    players, _g = S.selection_sufficiency(candidates(t))
    return players.select("entity", "role", "rank", "urank", *r6("lo90", "hi90"), "covered", "stable", "reason", "needed")


CTE["sgate"] = """
SELECT r.role, eligible, stable_n, required, r.covered_n, coalesce(n,0) AS unresolved, r.enabled AND coalesce(n,0)=0 AS passed FROM srole r LEFT JOIN (SELECT role, count(*) AS n FROM suff WHERE reason<>'outside_decision_frontier' GROUP BY role) x ON r.role=x.role"""
CTE_DEPS["sgate"] = ("srole", "suff")


@query("K22_role_gates", "SELECT role, eligible, stable_n, required, covered_n, unresolved, passed FROM sgate", ("sgate",))
def _(t):
    _p, gates = S.selection_sufficiency(candidates(t))
    return gates.select("role", "eligible", "stable_n", "required", "covered_n", "unresolved", "passed")


@query(
    "K23_candidate_gate",
    """SELECT led."window", count(DISTINCT led.entity) AS relevant, count(DISTINCT CASE WHEN passed THEN led.entity END) AS passing, round(avg(CASE WHEN passed THEN 1e0 ELSE 0e0 END),6) AS pass_rate, CAST(sum(missing) AS BIGINT) AS missing, bool_and(passed) AS gate
FROM led WHERE entity IN (SELECT s_suppkey FROM supplier WHERE s_acctbal>8000 UNION SELECT entity FROM (SELECT entity, row_number() OVER (PARTITION BY entity%8 ORDER BY 5e0*r+0.25e0*m/100e0 DESC, m DESC, entity) AS rn FROM (
  SELECT entity, sum(minutes) AS m, count(*) FILTER (flag='R')*90e0/sum(minutes) AS r FROM det GROUP BY entity) WHERE (entity%10)/10e0>=0.6) WHERE rn<=3) GROUP BY led."window" """,
    ("led", "det"),
)
def _(t):
    e = F.col("entity")
    base = t.details().groupBy("entity").agg(F.sum("minutes").alias("minutes"), (F.count_if(F.col("flag") == "R") * 90.0 / F.sum("minutes")).alias("r"))
    base = base.select("entity", (e % 8).alias("role"), ((e % 10) / 10.0).alias("role_stability"), (5.0 * F.col("r") + 0.25 * F.col("minutes") / 100.0).alias("score"), "minutes")
    bench = t.supplier.where(F.col("s_acctbal") > 8000).select(F.col("s_suppkey").alias("entity"))
    _u, out = S.candidate_gate(base, bench, ledger(t), 3)
    return out.select("window", "relevant", "passing", *r6("pass_rate"), "missing", "gate")


@query(
    "K24_challenger_priority",
    """SELECT s.entity, s.reason, round(p.pressure,6) AS role_pressure, round(CASE s.reason WHEN 'covered_pool_shortage' THEN 6e0 WHEN 'upper90_can_enter_real_xi' THEN 5e0 WHEN 'high_ability_role_stabilization' THEN 4.5e0 WHEN 'upper90_can_enter_top30' THEN 3.5e0 WHEN 'top35_guardrail' THEN 2.5e0 ELSE 1e0 END
  + 2*p.pressure + 1.5e0*coalesce(hi90-lo90,0e0) + 0.75e0*greatest(coalesce(hi90-f.best,0e0),0e0) + 0.35e0*greatest(coalesce(hi90-f.kth,0e0),0e0) + 0.15e0*ln(1+CAST(s.entity%6 AS DOUBLE)),6) AS decision_priority
FROM suff s JOIN front f ON s.entity=f.entity JOIN (SELECT role, greatest(greatest(required,1e0)-covered_n,0e0)/greatest(required,1e0)+0.25e0*unresolved/greatest(required,1e0) AS pressure FROM sgate) p ON s.role=p.role WHERE s.reason<>'outside_decision_frontier'""",
    ("suff", "front", "sgate"),
)
def _(t):
    from ..session import cut_lineage

    c = cut_lineage(candidates(t))
    players, gates = S.selection_sufficiency(c)
    front = S.selection_frontier(c).select("entity", "best_lower_threshold", "top30_lower_threshold")
    rows = players.where("needed").select("entity", "role", "reason", "lo90", "hi90", (F.col("entity") % 6).alias("missing")).join(front, "entity")
    return S.challenger_priority(rows, gates).select("entity", "reason", *r6("role_pressure", "decision_priority"))


def mb_players(t):
    """Scored candidates with observed and missing exposure."""
    c = candidates(t).where(F.col("overall").isNotNull())
    stable = (F.col("role_stability") >= 0.6) & (F.col("role_observations") >= 3)
    return c.select(
        "entity", "role", "minutes", "overall", F.coalesce("uncertainty", F.lit(0.25)).alias("uncertainty"), stable.alias("stable"), (F.col("pass_current") & F.col("pass_pre")).alias("covered"),
        F.col("minutes").alias("observed_minutes"), "missing_minutes",
    )


CTE["mb"] = """
SELECT entity, role, minutes, overall, coalesce(uncertainty,0.25e0) AS unc, role_stability>=0.6 AND role_observations>=3 AS stable, pass_current AND pass_pre AS covered, missing_minutes/(minutes+missing_minutes) AS w FROM cand WHERE overall IS NOT NULL"""
CTE_DEPS["mb"] = ("cand",)
CTE["mq"] = """
SELECT a.role, coalesce(g05,a05) AS q05, coalesce(g50,a50) AS q50, coalesce(g95,a95) AS q95 FROM (SELECT role, quantile_cont(overall,0.05) AS a05, quantile_cont(overall,0.5) AS a50, quantile_cont(overall,0.95) AS a95 FROM mb GROUP BY role) a
LEFT JOIN (SELECT role, quantile_cont(overall,0.05) AS g05, quantile_cont(overall,0.5) AS g50, quantile_cont(overall,0.95) AS g95 FROM mb WHERE stable AND covered GROUP BY role) g ON a.role=g.role"""
CTE_DEPS["mq"] = ("mb",)
CTE["ms"] = """
SELECT *, least(greatest(round(score-unc,9),0e0),1e0) AS cons FROM (
  SELECT entity, role, minutes, unc, stable, s.scenario, CASE s.scenario WHEN 'observed' THEN overall WHEN 'empirical_low' THEN (1-w)*overall+w*q05 WHEN 'empirical_median' THEN (1-w)*overall+w*q50 WHEN 'empirical_high' THEN (1-w)*overall+w*q95 WHEN 'strict_low' THEN (1-w)*overall ELSE (1-w)*overall+w END AS score
  FROM mb JOIN mq USING (role), (VALUES ('observed'),('empirical_low'),('empirical_median'),('empirical_high'),('strict_low'),('strict_high')) s(scenario))"""
CTE_DEPS["ms"] = ("mb", "mq")
CTE["mm"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario, role ORDER BY cons DESC, minutes DESC, entity) AS r FROM ms WHERE stable) WHERE r<=30"
CTE_DEPS["mm"] = ("ms",)


@query("K26_missingness_bounds", "SELECT scenario, role, entity, r AS scenario_rank, round(score,6) AS score, round(cons,6) AS conservative FROM mm", ("mm",))
def _(t):
    members, _s, _r = S.missingness_bounds(mb_players(t))
    return members.select("scenario", "role", "entity", "scenario_rank", *r6("score", "conservative"))


@query(
    "K26_stability",
    """SELECT w.scenario, count(*) AS set_n, count(b.entity) AS both_n, round(count(b.entity)*1e0/(count(*)+(SELECT count(DISTINCT entity) FROM mm WHERE r=1 AND scenario='observed')-count(b.entity)),6) AS jaccard,
  count(*)+(SELECT count(DISTINCT entity) FROM mm WHERE r=1 AND scenario='observed')-2*count(b.entity) AS symmetric_difference
FROM (SELECT DISTINCT scenario, entity FROM mm WHERE r=1) w LEFT JOIN (SELECT DISTINCT entity FROM mm WHERE r=1 AND scenario='observed') b ON w.entity=b.entity GROUP BY w.scenario""",
    ("mm",),
)
def _(t):
    _m, stability, _r = S.missingness_bounds(mb_players(t))
    return stability.select("scenario", "set_n", "both_n", *r6("jaccard"), "symmetric_difference")


CTE["ident"] = """
SELECT w.role, w.n AS scenario_winners, l.entity AS strict_candidate, coalesce(l.cons > (SELECT max(h.cons) FROM ms h WHERE h.stable AND h.scenario='strict_high' AND h.role=l.role AND h.entity<>l.entity), true) AS strict_identified FROM
 (SELECT role, count(DISTINCT entity) AS n FROM mm WHERE r=1 GROUP BY role) w JOIN (SELECT * FROM mm WHERE scenario='strict_low' AND r=1) l ON w.role=l.role"""
CTE_DEPS["ident"] = ("mm", "ms")


@query("K26_identification", "SELECT role, scenario_winners, strict_candidate, strict_identified, scenario_winners=1 AND strict_identified AS point_identified FROM ident", ("ident",))
def _(t):
    _m, _s, roles = S.missingness_bounds(mb_players(t))
    return roles.select("role", "scenario_winners", "strict_candidate", "strict_identified", "point_identified")


@query(
    "K27_identified_set",
    """SELECT role, entity, count(*) OVER (PARTITION BY role) AS candidates, count(*) OVER (PARTITION BY role)=1 AS invariant FROM (SELECT DISTINCT role, entity FROM mm WHERE r=1)""",
    ("mm",),
)
def _(t):
    scores = S.missingness_scores(mb_players(t))
    core, _c = S.identified_set(S.scenario_members(scores, 1))
    return core.select("role", "entity", "candidates", "invariant")


@query(
    "K27_combinations",
    """WITH c AS (SELECT role, entity, row_number() OVER (PARTITION BY role ORDER BY entity)-1 AS d, count(*) OVER (PARTITION BY role) AS n FROM (SELECT DISTINCT role, entity FROM mm WHERE r=1)),
s AS (SELECT role, max(n) AS n, row_number() OVER (ORDER BY role) AS k FROM c GROUP BY role),
t AS (SELECT a.role, a.n, CAST(coalesce(product(b.n),1) AS BIGINT) AS stride FROM s a LEFT JOIN s b ON b.k>a.k GROUP BY ALL)
SELECT id+1 AS combination, t.role, c.entity FROM (SELECT unnest(range(0, (SELECT CAST(product(n) AS BIGINT) FROM s))) AS id), t JOIN c ON c.role=t.role AND c.d=(id//stride)%t.n""",
    ("mm",),
)
def _(t):
    scores = S.missingness_scores(mb_players(t))
    return S.identified_set(S.scenario_members(scores, 1))[1]


_KD = [d for d in DIMS if d != "duels_dim"]


@query(
    "K28_pooled_centroid_team",
    "SELECT role, max(n) AS members, "
    + ", ".join(
        f"round(avg(CASE WHEN NOT (n > 2*cut) OR (k_{d} > cut AND k_{d} <= n-cut) THEN {d} END),6) AS {d}" for d in _KD
    )
    + ", round(greatest(0.025e0, avg(uncertainty)/sqrt(max(n))),6) AS uncertainty FROM (SELECT *, CAST(floor(n*0.1e0) AS BIGINT) AS cut FROM (SELECT *, count(*) OVER (PARTITION BY role) AS n, "
    + ", ".join(f"row_number() OVER (PARTITION BY role ORDER BY {d}) AS k_{d}" for d in _KD)
    + " FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conservative_score DESC, minutes DESC, entity) AS rn FROM cand WHERE overall IS NOT NULL) WHERE rn<=20)) GROUP BY role",
    ("cand",),
)
def _(t):
    pool = candidates(t).where(F.col("overall").isNotNull())
    out = ranking.pooled_centroid_team(pool, 20, "pooled", _KD)
    return out.select("role", "members", *r6(*_KD, "uncertainty"))
