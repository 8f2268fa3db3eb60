"""Role inference and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.tables import literal_table
from ..plans import ranking
from ..plans import roles as R
from ..presets.football import BROAD_OF, DIMENSIONS, ELEVEN, ROLE_WEIGHTS, ROLES
from ..presets.formations import generic_rows, template_rows
from .base import CTE, CTE_DEPS, query
from .windows_q import features

# Line-ups of the shared-table binding: five formations, eleven places each.
_FORMATIONS = {0: "4-3-3", 1: "3-4-3", 2: "4-2-3-1", 3: "4-4-2", 4: "6-3-1"}


def _places():
    out = []
    for i, text in _FORMATIONS.items():
        sizes = [1, *[int(x) for x in text.split("-")]]
        k = 0
        for row, size in enumerate(sizes, 1):
            pos = "G" if row == 1 else "D" if row == 2 else "F" if row == len(sizes) else "M"
            for col in range(1, size + 1):
                k += 1
                out.append((i, text, k, row, col, pos))
    return out


def lineups(t):
    """Each order fields the eleven of its customer in one of five formations; places
    rotate with the order, so an entity is seen in several roles."""
    place = literal_table(
        t.spark, [("f", "int"), ("formation", "string"), ("k", "int"), ("row", "int"), ("col", "int"), ("pos", "string")], _places()
    )
    o = t.orders.select(
        F.col("o_orderkey").alias("unit"), F.col("o_custkey").alias("side"), (F.col("o_orderkey") % 5).cast("int").alias("f"), F.explode(F.sequence(F.lit(1), F.lit(11))).alias("k")
    )
    entity = F.col("side") * 20 + (F.col("k") + (F.col("unit") % 4 == 0).cast("int")) % 11
    return o.join(place, ["f", "k"]).select(
        "unit", "side", entity.alias("entity"), "formation", "row", "col", "pos", ((F.col("unit") * 7 + F.col("k")) % 90 + 1).cast("double").alias("minutes")
    )


CTE["lup"] = (
    "SELECT o_orderkey AS unit, o_custkey AS side, o_custkey*20 + (p.k + CAST(o_orderkey%4=0 AS INTEGER))%11 AS entity, p.formation, p.row, p.col, p.pos, CAST((o_orderkey*7+p.k)%90+1 AS DOUBLE) AS minutes FROM orders JOIN (VALUES "
    + ", ".join(f"({i},'{t}',{k},{r},{c},'{p}')" for i, t, k, r, c, p in _places())
    + ") p(f,formation,k,row,col,pos) ON o_orderkey%5=p.f"
)
CTE["inf"] = """
SELECT *, CASE WHEN pos='G' OR row=1 THEN 'GK' WHEN pos='D' AND sz>=4 AND edge THEN 'FB' WHEN pos='D' THEN 'CB' WHEN pos='F' AND edge THEN 'W' WHEN pos='F' THEN 'ST'
  WHEN pos='M' AND formation LIKE '3-%' AND mr=1 AND sz>=4 AND edge THEN 'FB' WHEN pos='M' AND mr>=2 AND edge AND row=mh THEN 'W' WHEN pos='M' AND mr>=2 AND row=ml THEN 'DM' WHEN pos='M' AND mr>=2 AND row=mh THEN 'AM' ELSE 'CM' END AS role
FROM (SELECT *, sz>=3 AND (col=1 OR col=sz) AS edge FROM (SELECT *, count(*) OVER (PARTITION BY unit, side, row) AS sz, min(CASE WHEN pos='M' THEN row END) OVER w AS ml, max(CASE WHEN pos='M' THEN row END) OVER w AS mh,
  count(DISTINCT CASE WHEN pos='M' THEN row END) OVER w AS mr FROM lup WINDOW w AS (PARTITION BY unit, side)))"""
CTE_DEPS["inf"] = ("lup",)
_ROLE_ORDER = "CASE role " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(ROLES)) + " ELSE 99 END"
CTE["prim"] = f"""
SELECT entity, role AS primary_role, m/total AS role_share, total AS precise_minutes, m/total < 0.6 AS ambiguous FROM (
  SELECT *, sum(m) OVER (PARTITION BY entity) AS total, row_number() OVER (PARTITION BY entity ORDER BY m DESC, {_ROLE_ORDER}) AS rn FROM (SELECT entity, role, sum(minutes) AS m FROM inf GROUP BY ALL)) WHERE rn=1"""
CTE_DEPS["prim"] = ("inf",)


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def inferred(t):
    keep = R.infer_roles(lineups(t).drop("minutes"))
    return keep.join(lineups(t).select("unit", "entity", "minutes"), ["unit", "entity"])


@query("K1_infer_roles", "SELECT unit, entity, formation, row, col, role FROM inf", ("inf",))
def _(t):
    return R.infer_roles(lineups(t)).select("unit", "entity", "formation", "row", "col", "role")


@query("K2_primary_role", "SELECT entity, primary_role, round(role_share,6) AS role_share, precise_minutes, ambiguous FROM prim", ("prim",))
def _(t):
    out = R.primary_role(R.infer_roles(lineups(t)))
    return out.select("entity", "primary_role", *r6("role_share"), "precise_minutes", "ambiguous")


def _appearances(t):
    """Short starts carry no precise role, so that some are recovered."""
    rows = lineups(t).select("unit", "entity", "minutes")
    starts = R.infer_roles(lineups(t)).where(F.col("minutes") > 30).select("unit", "entity", "role")
    return rows, starts


@query(
    "K3_attribute_to_role",
    """SELECT l.unit, l.entity, primary_role, CASE WHEN primary_role IS NULL THEN 'excluded' WHEN r.role IS NULL THEN 'recovered' WHEN r.role=primary_role THEN 'consistent' ELSE 'reassigned' END AS source
FROM lup l LEFT JOIN (SELECT unit, entity, role FROM inf WHERE minutes>30) r ON l.unit=r.unit AND l.entity=r.entity LEFT JOIN (SELECT * FROM prim WHERE NOT ambiguous) p ON l.entity=p.entity""",
    ("lup", "inf", "prim"),
)
def _(t):
    rows, starts = _appearances(t)
    primary = R.primary_role(R.infer_roles(lineups(t)))
    return R.attribute_to_role(rows, starts, primary).select("unit", "entity", "primary_role", "source")


@query("K35_attribute_starters_only", "SELECT CASE WHEN minutes>30 THEN role END AS role, count(*) AS n FROM inf GROUP BY 1", ("inf",))
def _(t):
    return R.attribute_starters_only(*_appearances(t))[1]


# Composites of the shared-table binding: dimension -> SQL over the rates, valid in both.
COMPOSITES = {
    "build_up": "0.45*passes_p90 + 25*pass_completion",
    "progression": "2.5*duels_won_p90 + 0.5*yellow_p90",
    "creation": "5.5*goals_p90 + 2.5*shots_p90",
    "finishing": "8.0*goals_p90 + 1.4*shots_p90",
    "defending": "1.8*saves_p90 + 1.1*duels_p90",
    "duels_dim": "1.4*duels_won_p90 + 3.0*duel_success",
    "retention": "3.5*pass_completion + 0.4*duel_success - 0.08*yellow_p90",
    "goalkeeping": "1.5*saves_p90 + 0.2*pass_completion",
}
DIMS = tuple(COMPOSITES)
_RATES = ("shots", "goals", "saves", "passes", "duels", "duels_won", "yellow")
BROAD = {"ECONOMY": "G", "LARGE": "D", "MEDIUM": "M", "PROMO": "M", "SMALL": "F", "STANDARD": "D"}


def _d(text: str) -> str:
    """Decimal literals as doubles for DuckDB."""
    import re

    return re.sub(r"\b(\d+\.\d+)\b", r"\1e0", text)


CTE["prof0"] = (
    "SELECT entity, cohort, minutes, shots, CASE cohort "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BROAD.items())
    + " END AS broad, "
    + ", ".join(f"{x}*90e0/minutes AS {x}_p90" for x in _RATES)
    + ", passes_accurate/passes AS pass_completion, duels_won/duels AS duel_success FROM feat WHERE minutes>=450"
)
CTE_DEPS["prof0"] = ("feat",)
CTE["prof1"] = "SELECT *, " + ", ".join(f"{_d(e)} AS {d}_raw" for d, e in COMPOSITES.items()) + " FROM prof0"
CTE_DEPS["prof1"] = ("prof0",)
CTE["prof"] = (
    "SELECT prof1.*, least(greatest(0.22e0/sqrt(greatest(minutes/450e0,1e0)),0.035e0),0.18e0) AS uncertainty, "
    + ", ".join(f"1e0/(1e0+exp(-least(greatest(({d}_raw-q.{d}_2)/greatest(q.{d}_3-q.{d}_1,1e-9),-8e0),8e0))) AS {d}" for d in DIMS)
    + " FROM prof1, (SELECT "
    + ", ".join(f"quantile_cont({d}_raw,{p}) AS {d}_{i}" for d in DIMS for i, p in ((1, 0.25), (2, 0.5), (3, 0.75)))
    + " FROM prof1) q"
)
CTE_DEPS["prof"] = ("prof1",)


def profiles(t):
    broad = None
    for k, v in BROAD.items():
        broad = F.when(F.col("cohort") == k, v) if broad is None else broad.when(F.col("cohort") == k, v)
    totals = features(t).select("entity", "cohort", "minutes", *_RATES, "passes_accurate", broad.alias("broad"))
    return ranking.profile_dimensions(
        totals, _RATES, {"pass_completion": ("passes_accurate", "passes"), "duel_success": ("duels_won", "duels")},
        {d: F.expr(_spark(e)) for d, e in COMPOSITES.items()},
    )


def _spark(text: str) -> str:
    """Decimal literals as doubles for Spark."""
    import re

    return re.sub(r"\b(\d+\.\d+)\b", r"\1D", text)


@query("K8_profile_dimensions", "SELECT entity, broad, round(uncertainty,6) AS uncertainty, " + ", ".join(f"round({d},6) AS {d}" for d in DIMS) + " FROM prof", ("prof",))
def _(t):
    return profiles(t).select("entity", "broad", *r6("uncertainty", *DIMS))


def named(df):
    """Profile rows under the dimension names of the role rules."""
    return df.withColumn("duels", F.col("duels_dim"))


_SQUAD = "CASE broad WHEN 'G' THEN 'Goalkeeper' WHEN 'D' THEN 'Defender' WHEN 'F' THEN 'Attacker' ELSE 'Midfielder' END"


@query(
    "K9_role_rules",
    """SELECT entity, CASE WHEN broad='G' THEN 'GK' WHEN broad='D' THEN CASE WHEN entity%2=0 AND (entity%3=0 OR entity%4<=2) THEN 'FB' ELSE 'CB' END WHEN broad='F' THEN CASE WHEN progression+creation-finishing>0.18 THEN 'W' ELSE 'ST' END
  WHEN 0.62e0*defending+0.38e0*duels_dim-(0.55e0*creation+0.45e0*progression)>0.18 THEN 'DM' WHEN 0.55e0*creation+0.45e0*progression-(0.62e0*defending+0.38e0*duels_dim)>0.2 THEN 'AM' ELSE 'CM' END AS role FROM prof""",
    ("prof",),
)
def _(t):
    p = named(profiles(t))
    band = F.when(F.col("entity") % 2 == 0, "outer-low").otherwise("central")
    grid_row = F.when(F.col("entity") % 3 != 0, (F.col("entity") % 4).cast("double"))
    squad = F.when(F.col("broad") == "G", "Goalkeeper").when(F.col("broad") == "D", "Defender").when(F.col("broad") == "F", "Attacker").otherwise("Midfielder")
    return p.select("entity", R.role_rules(band, grid_row, squad, F.lit(None).cast("string")).alias("role"))


CTE["sig"] = (
    "SELECT *, CASE broad "
    + " ".join(
        f"WHEN '{g}' THEN round(" + " + ".join(f"({w!r}e0)*{'duels_dim' if d == 'duels' else d}" for d, w in ws.items()) + ",9)" for g, ws in R.GROUP_SIGNALS.items()
    )
    + " END AS s FROM prof"
)
CTE_DEPS["sig"] = ("prof",)
CTE["prole"] = """
SELECT *, CASE WHEN broad='G' THEN 'GK' WHEN broad='D' THEN CASE WHEN p>=0.56 THEN 'FB' ELSE 'CB' END WHEN broad='F' THEN CASE WHEN p>=0.6 THEN 'ST' ELSE 'W' END WHEN p<=0.3 THEN 'DM' WHEN p>=0.7 THEN 'AM' ELSE 'CM' END AS role
FROM (SELECT *, (rank() OVER (PARTITION BY broad ORDER BY s) + (count(*) OVER (PARTITION BY broad, s)-1)/2e0)/count(s) OVER (PARTITION BY broad) AS p FROM sig)"""
CTE_DEPS["prole"] = ("sig",)


def with_roles(t):
    from ..session import cut_lineage

    return R.role_by_cohort_percentile(cut_lineage(named(profiles(t))))


@query("K10_role_by_cohort_percentile", "SELECT entity, broad, CASE WHEN broad<>'G' THEN round(p,6) END AS signal_pct, role FROM prole", ("prole",))
def _(t):
    return with_roles(t).select("entity", "broad", *r6("signal_pct"), "role")


_CODE = "CASE pos WHEN 'G' THEN 'G' WHEN 'D' THEN 'D' WHEN 'F' THEN 'F' ELSE 'M' END"
CTE["sr"] = """
SELECT *, CASE WHEN pos='G' THEN 'GK' WHEN pos='D' AND (x<=0.34 OR x>=0.82) THEN z||'B' WHEN pos='D' THEN z||'CB' WHEN pos='F' AND (x<=0.34 OR x>=0.82) THEN z||'W' WHEN pos='F' THEN 'ST' WHEN d<=0.38 THEN 'DM' WHEN d>=0.7 THEN 'AM' ELSE 'CM' END AS role
FROM (SELECT *, CASE WHEN x<=0.5 THEN 'L' ELSE 'R' END AS z FROM (SELECT *, col*1e0/max(col) OVER (PARTITION BY unit, side, row) AS x, least(greatest((row-2)*1e0/greatest(max(row) OVER (PARTITION BY unit, side)-2,1),0e0),1e0) AS d FROM lup))"""
CTE_DEPS["sr"] = ("lup",)


@query(
    "K11_resolve_side_roles",
    """SELECT b.entity, role AS resolved_role, round(n*1e0/tot,6) AS role_stability, CAST(tot AS BIGINT) AS role_observations, dist AS distribution, n*1e0/tot>=0.6 AS stable_role, n*1e0/tot>=0.6 AND m>=300 AND b.entity%3<>0 AS eligible FROM (
  SELECT *, sum(n) OVER (PARTITION BY entity) AS tot, row_number() OVER (PARTITION BY entity ORDER BY n DESC, role) AS rn FROM (SELECT entity, role, count(*) AS n FROM sr GROUP BY ALL)) b
JOIN (SELECT entity, string_agg(role||':'||n, ' | ' ORDER BY n DESC, role) AS dist FROM (SELECT entity, role, count(*) AS n FROM sr GROUP BY ALL) GROUP BY entity) d ON b.entity=d.entity
JOIN (SELECT entity, sum(minutes) AS m FROM lup GROUP BY entity) c ON b.entity=c.entity WHERE rn=1""",
    ("sr", "lup"),
)
def _(t):
    starts = lineups(t).withColumnRenamed("pos", "code")
    cov = lineups(t).groupBy("entity").agg(F.sum("minutes").alias("reported_minutes")).withColumn("covered", F.col("entity") % 3 != 0)
    out = R.resolve_side_roles(starts, "low_is_left", cov, 300.0)
    return out.select("entity", "resolved_role", *r6("role_stability"), "role_observations", "distribution", "stable_role", "eligible")


@query(
    "K12_validate_orientation",
    """SELECT mapping, count(*) AS anchors, CAST(sum(n) AS BIGINT) AS observations, round(sum(ok)/sum(n),6) AS observation_agreement, round(avg(CASE WHEN ok/n>=0.5 THEN 1e0 ELSE 0e0 END),6) AS entity_agreement,
  count(*)>=5 AND sum(n)>=15 AND sum(ok)/sum(n)>=0.8 AND avg(CASE WHEN ok/n>=0.5 THEN 1e0 ELSE 0e0 END)>=0.8 AS accepted FROM (
  SELECT mapping, entity, count(*) AS n, sum(CASE WHEN (CASE WHEN x<=0.34 THEN lo ELSE hi END)=expected THEN 1e0 ELSE 0e0 END) AS ok FROM (
    SELECT entity, x, CASE WHEN entity%20<6 THEN 'L' ELSE 'R' END AS expected FROM sr WHERE pos='D' AND (x<=0.34 OR x>=0.76)) , (VALUES ('low_is_left','L','R'),('low_is_right','R','L')) m(mapping,lo,hi) GROUP BY ALL) GROUP BY mapping""",
    ("sr",),
)
def _(t):
    from ..operators.windows import group_extent

    seen = group_extent(lineups(t)).where(F.col("pos") == "D").select("entity", (F.col("col") / F.col("row_width")).alias("x"))
    anchors = seen.select("entity").distinct().withColumn("expected_side", F.when(F.col("entity") % 20 < 6, "L").otherwise("R"))
    out = R.validate_orientation(seen, anchors)
    return out.select("mapping", "anchors", "observations", *r6("observation_agreement", "entity_agreement"), "accepted")


CTE["tpl"] = "SELECT * FROM (VALUES " + ", ".join(f"('{f}',{l},{s},{p},'{r}')" for f, l, s, p, r in template_rows()) + ") v(formation,line,line_size,place,role)"
CTE["gen"] = "SELECT * FROM (VALUES " + ", ".join(f"('{k}',{s},{p},'{r}')" for k, s, p, r in generic_rows()) + ") v(kind,line_size,place,role)"
CTE["tr"] = """
SELECT l.unit, l.entity, l.minutes, l.formation, CASE WHEN row=1 THEN 'GK' ELSE coalesce(t.role, g.role, 'UNRESOLVED') END AS role, CASE WHEN row=1 THEN 'goalkeeper_grid' WHEN t.role IS NOT NULL THEN 'formation_template' ELSE 'formation_generic' END AS method FROM (
  SELECT *, CASE WHEN line=1 THEN 'first' WHEN line=len(string_split(formation,'-')) THEN 'last' WHEN line=2 AND formation LIKE '3-%' THEN 'wing' WHEN line=2 THEN 'second' ELSE 'later' END AS kind FROM (
   SELECT *, dense_rank() OVER (PARTITION BY unit, side ORDER BY row)-1 AS line, count(*) OVER (PARTITION BY unit, side, row) AS line_size, row_number() OVER (PARTITION BY unit, side, row ORDER BY col, entity) AS place FROM lup)) l
LEFT JOIN tpl t ON l.formation=t.formation AND l.line=t.line AND l.line_size=t.line_size AND l.place=t.place LEFT JOIN gen g ON l.kind=g.kind AND l.line_size=g.line_size AND l.place=g.place"""
CTE_DEPS["tr"] = ("lup", "tpl", "gen")


@query("K13_template_roles", "SELECT unit, entity, formation, role, method FROM tr", ("tr",))
def _(t):
    return R.template_roles(lineups(t)).select("unit", "entity", "formation", "role", "method")


CTE["trp"] = """
SELECT entity, role, sum(minutes) AS m, count(DISTINCT unit) AS n FROM tr WHERE role<>'UNRESOLVED' GROUP BY ALL"""
CTE_DEPS["trp"] = ("tr",)
CTE["tagg"] = f"""
SELECT entity, raw_role, CASE WHEN raw_role='CB' THEN CASE WHEN entity%2=0 THEN 'RCB' END WHEN raw_role IN {ELEVEN} THEN raw_role END AS formation_role, m/total AS stability, total AS precise_minutes, CAST(obs AS BIGINT) AS observations FROM (
  SELECT entity, role AS raw_role, m, sum(m) OVER (PARTITION BY entity) AS total, sum(n) OVER (PARTITION BY entity) AS obs, row_number() OVER (PARTITION BY entity ORDER BY m DESC, n DESC, role) AS rn FROM trp) WHERE rn=1"""
CTE_DEPS["tagg"] = ("trp",)


def template_agg(t):
    ev = R.template_roles(lineups(t)).select("unit", "entity", "role").join(lineups(t).select("unit", "entity", "minutes"), ["unit", "entity"])
    current = t.customer.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.col("c_custkey") * 20 + k)).alias("entity"))
    current = current.withColumn("current_role", F.when(F.col("entity") % 2 == 0, "RCB").otherwise("LW"))
    return R.aggregate_template_roles(ev, current, ELEVEN)


@query(
    "K14_aggregate_template_roles",
    """SELECT tagg.entity, raw_role, formation_role, round(stability,6) AS stability, precise_minutes, observations, distribution FROM tagg JOIN (
  SELECT entity, string_agg(role||':'||CAST(round(m) AS BIGINT)||'m/'||n, ' | ' ORDER BY m DESC, n DESC, role) AS distribution FROM trp GROUP BY entity) USING (entity)""",
    ("tagg", "trp"),
)
def _(t):
    return template_agg(t).select("entity", "raw_role", "formation_role", *r6("stability"), "precise_minutes", "observations", "distribution")


CTE["aud0"] = """
SELECT entity, CASE WHEN entity%2=0 THEN 'RCB' ELSE 'LW' END AS current_role, formation_role, precise_minutes AS minutes, CASE entity%5 WHEN 0 THEN 'RB|LB' WHEN 1 THEN 'ST' WHEN 2 THEN 'CM|AM' WHEN 3 THEN 'RCB|LW' END AS allowed,
  CASE WHEN entity%7=0 THEN 'CM' WHEN entity%7=1 THEN 'RB' END AS preferred FROM tagg"""
CTE_DEPS["aud0"] = ("tagg",)
CTE["aud1"] = """
SELECT *, CASE WHEN allowed IS NOT NULL AND list_contains(string_split(allowed,'|'), formation_role) THEN 'formation_and_public_agree' WHEN allowed IS NOT NULL AND list_contains(string_split(allowed,'|'), preferred) THEN 'public_preferred_override'
  WHEN allowed='ST' THEN 'single_public_role_override' WHEN allowed IS NOT NULL AND list_contains(string_split(allowed,'|'), current_role) THEN 'current_role_publicly_allowed' WHEN allowed IS NOT NULL THEN 'public_anchor_unresolved_conflict'
  WHEN formation_role IS NOT NULL THEN 'formation_only' ELSE 'current_fallback' END AS method FROM aud0"""
CTE_DEPS["aud1"] = ("aud0",)


def _aud_score() -> str:
    parts = []
    for role, b in BROAD_OF.items():
        terms = " + ".join(f"{w!r}e0*{'0.5e0' if d == 'base' else f'((entity+{DIMENSIONS.index(d)})%50/50e0)'}" for d, w in ROLE_WEIGHTS[b].items())
        parts.append(f"WHEN '{role}' THEN {terms}")
    return "CASE audited_role " + " ".join(parts) + " END"


CTE["aud"] = f"""
SELECT *, row_number() OVER (PARTITION BY audited_role ORDER BY audited_score DESC NULLS LAST, minutes DESC, entity) AS audited_rank FROM (SELECT *, round({_aud_score()} - (entity%10)/100e0, 9) AS audited_score FROM (
  SELECT *, CASE WHEN method IN ('formation_and_public_agree','formation_only') THEN formation_role WHEN method='public_preferred_override' THEN preferred WHEN method='single_public_role_override' THEN 'ST' WHEN method IN ('current_role_publicly_allowed','current_fallback') THEN current_role END AS audited_role FROM aud1))"""
CTE_DEPS["aud"] = ("aud1",)


def audited(t):
    agg = template_agg(t)
    k = F.col("entity") % 5
    rows = agg.select(
        "entity", F.when(F.col("entity") % 2 == 0, "RCB").otherwise("LW").alias("current_role"), "formation_role", F.col("precise_minutes").alias("minutes"),
        F.when(k == 0, "RB|LB").when(k == 1, "ST").when(k == 2, "CM|AM").when(k == 3, "RCB|LW").alias("allowed"),
        F.when(F.col("entity") % 7 == 0, "CM").when(F.col("entity") % 7 == 1, "RB").alias("preferred"),
        ((F.col("entity") % 10) / 100.0).alias("uncertainty"), *[(((F.col("entity") + i) % 50) / 50.0).alias(d) for i, d in enumerate(DIMENSIONS)],
    )
    return R.reconcile_role_evidence(rows, BROAD_OF, ROLE_WEIGHTS)


@query(
    "K15_reconcile_role_evidence",
    "SELECT entity, method, audited_role, round(audited_score,6) AS audited_score, audited_role IS DISTINCT FROM current_role AS changed, method='public_anchor_unresolved_conflict' AS conflict, audited_rank FROM aud",
    ("aud",),
)
def _(t):
    return audited(t).select("entity", "method", "audited_role", *r6("audited_score"), "changed", "conflict", "audited_rank")


@query(
    "K37_high_impact_set",
    "SELECT DISTINCT entity FROM (SELECT entity FROM top20 UNION ALL SELECT entity FROM cand3)",
    ("top20", "cand3"),
)
def _(t):
    from .joins_q import candidates3
    from .windows_q import ranked

    return R.high_impact_set(ranking.top_members(ranked(t), 20), candidates3(t))


@query(
    "K38_convergence_check",
    "SELECT s_suppkey*20+3 AS entity, s_name AS source, audited_rank, audited_rank IS NULL AS rank_missing FROM supplier LEFT JOIN (SELECT entity, audited_rank FROM aud WHERE audited_role IS NOT NULL) a ON s_suppkey*20+3=a.entity",
    ("aud",),
)
def _(t):
    evidence = t.supplier.select((F.col("s_suppkey") * 20 + 3).alias("entity"), F.col("s_name").alias("source"))
    ranks = audited(t).where(F.col("audited_role").isNotNull()).select("entity", "audited_rank")
    return R.convergence_check(evidence, ranks).select("entity", "source", "audited_rank", "rank_missing")


CTE["sq0"] = """
SELECT *, 5e0*(goals*90e0/minutes)+0.7e0*(shots*90e0/minutes) AS attack_raw, 0.015e0*(passes*90e0/minutes)+0.35e0*(duels_won*90e0/minutes) AS control_raw, 0.45e0*(saves*90e0/minutes)+0.35e0*(duels_won*90e0/minutes) AS defence_raw FROM (
  SELECT entity, side, sum(minutes) AS minutes, sum(goals) AS goals, sum(shots) AS shots, sum(passes) AS passes, sum(duels_won) AS duels_won, sum(saves) AS saves FROM eu GROUP BY ALL)"""
CTE_DEPS["sq0"] = ("eu",)
CTE["sq"] = (
    "SELECT sq0.*, "
    + ", ".join(f"1e0/(1e0+exp(-least(greatest(({d}_raw-{d}_2)/greatest({d}_3-{d}_1,1e-9),-8e0),8e0))) AS {d}" for d in ("attack", "control", "defence"))
    + " FROM sq0, (SELECT "
    + ", ".join(f"quantile_cont({d}_raw,{p}) AS {d}_{i}" for d in ("attack", "control", "defence") for i, p in ((1, 0.25), (2, 0.5), (3, 0.75)))
    + " FROM sq0)"
)
CTE_DEPS["sq"] = ("sq0",)


@query(
    "K36_squad_strength",
    """SELECT side, members, round(strength,6) AS strength, round(attack,6) AS attack, round(defence,6) AS defence, round((strength-avg(strength) OVER ())/greatest(stddev_pop(strength) OVER (),1e-9),6) AS z FROM (
 SELECT side, count(*) AS members, sum(w*strength)/sum(w) AS strength, sum(w*attack)/sum(w) AS attack, sum(w*defence)/sum(w) AS defence FROM (
  SELECT *, sqrt(greatest(minutes,90e0)) AS w, row_number() OVER (PARTITION BY side ORDER BY strength DESC, entity) AS rn FROM (SELECT *, round(0.42e0*attack+0.25e0*control+0.33e0*defence,12) AS strength FROM sq WHERE minutes>=60)) WHERE rn<=18 GROUP BY side)""",
    ("sq",),
)
def _(t):
    totals = t.entity_units().groupBy("entity", "side").agg(*[F.sum(x).alias(x) for x in ("minutes", "goals", "shots", "passes", "duels_won", "saves")])
    p90 = lambda x: F.col(x) * 90.0 / F.col("minutes")
    raws = {"attack": 5.0 * p90("goals") + 0.7 * p90("shots"), "control": 0.015 * p90("passes") + 0.35 * p90("duels_won"), "defence": 0.45 * p90("saves") + 0.35 * p90("duels_won")}
    out = ranking.squad_strength(totals, "side", "entity", raws, 18, 60.0)
    return out.select("side", "members", *r6("strength", "attack", "defence", "z"))
