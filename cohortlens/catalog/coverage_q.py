"""Coverage ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.filters import window_membership
from ..plans import coverage as C
from .aggregates_q import WINDOWS
from .base import CTE, CTE_DEPS, query
from .joins_q import expected

W = list(WINDOWS)


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def entities(t):
    """Suppliers with a reported total (every third one has none)."""
    total = t.lineitem.groupBy(F.col("l_suppkey").alias("entity")).agg(F.sum("l_quantity").alias("q"))
    return total.select("entity", F.when(F.col("entity") % 3 != 0, F.floor(F.col("q") / 4).cast("double")).alias("reported_minutes"))


CTE["ents"] = "SELECT l_suppkey AS entity, CASE WHEN l_suppkey%3<>0 THEN floor(sum(l_quantity)/4) END AS reported_minutes FROM lineitem GROUP BY l_suppkey"


def processed(t):
    return t.units().where(F.col("status") != "NS").select("unit")


CTE["proc"] = "SELECT unit FROM u WHERE status<>'NS'"
CTE_DEPS["proc"] = ("u",)


def pair_details(t):
    """One detail row per (unit, entity) of finished units, last line wins."""
    rows = t.details().where(F.col("flag") != "N")
    return C.dedupe_details(rows, ["line", "shipped", "part", "minutes"]).select("unit", "entity", "minutes")


CTE["pd"] = """
SELECT unit, entity, minutes FROM (SELECT *, row_number() OVER (PARTITION BY unit, entity ORDER BY line DESC, shipped DESC, part DESC, minutes DESC) AS rn FROM det WHERE flag<>'N') WHERE rn=1"""
CTE_DEPS["pd"] = ("det",)


def flags(t):
    return t.units().select("unit", "official", "in_current", "in_pre", "status")


def window_details(t):
    return window_membership(pair_details(t).join(flags(t), "unit"), WINDOWS).select("entity", "window", "unit", "minutes")


CTE["pdw"] = """
SELECT entity, 'current' AS "window", unit, minutes FROM pd JOIN u USING (unit) WHERE in_current UNION ALL SELECT entity, 'pre', unit, minutes FROM pd JOIN u USING (unit) WHERE in_pre"""
CTE_DEPS["pdw"] = ("pd", "u")
CTE["spine"] = """SELECT entity, reported_minutes, w AS "window" FROM ents, (VALUES ('current'),('pre')) v(w)"""
CTE_DEPS["spine"] = ("ents",)
CTE["led"] = """
SELECT *, expected-processed AS missing, CASE WHEN expected>0 THEN processed*1e0/expected END AS unit_coverage, detail_minutes/nullif(reported,0) AS raw, CASE WHEN reported>0 THEN least(detail_minutes/reported,1e0) END AS clipped,
  coalesce(expected>0 AND processed*1e0/expected>=0.8 AND (reported IS NULL OR reported=0 OR least(detail_minutes/reported,1e0)>=0.8), false) AS passed FROM (
  SELECT s.entity, s."window", coalesce(e.expected,0) AS expected, coalesce(e.processed,0) AS processed, coalesce(d.units,0) AS detail_units, coalesce(d.m,0e0) AS detail_minutes, CASE WHEN s."window"='current' THEN s.reported_minutes END AS reported
  FROM spine s LEFT JOIN (SELECT entity, "window", count(*) AS expected, count(p.unit) AS processed FROM exp LEFT JOIN proc p ON exp.unit=p.unit GROUP BY ALL) e ON s.entity=e.entity AND s."window"=e."window"
  LEFT JOIN (SELECT entity, "window", count(DISTINCT unit) AS units, sum(minutes) AS m FROM pdw GROUP BY ALL) d ON s.entity=d.entity AND s."window"=d."window")"""
CTE_DEPS["led"] = ("spine", "exp", "proc", "pdw")


def ledger(t):
    return C.coverage_ledger(entities(t), expected(t), processed(t), window_details(t), W, "current")


@query(
    "A7_coverage_ledger",
    """SELECT entity, "window", expected, processed, missing, round(unit_coverage,6) AS unit_coverage, detail_units, detail_minutes, reported AS reported_minutes, round(raw,6) AS minute_ratio_raw, round(clipped,6) AS minute_ratio_clipped, passed FROM led""",
    ("led",),
)
def _(t):
    return ledger(t).select(
        "entity", "window", "expected", "processed", "missing", *r6("unit_coverage"), "detail_units", "detail_minutes", "reported_minutes", *r6("minute_ratio_raw", "minute_ratio_clipped"), "passed"
    )


@query(
    "A7_missing_units",
    """SELECT exp.entity, exp."window", exp.unit FROM exp JOIN led ON exp.entity=led.entity AND exp."window"=led."window" WHERE NOT passed AND exp.unit NOT IN (SELECT unit FROM proc)""",
    ("exp", "led", "proc"),
)
def _(t):
    return C.missing_units(expected(t), processed(t), ledger(t))


def starters(t):
    return t.details().where(F.col("source") == "startXI").select("entity", "unit")


def exits(t):
    ev = t.details().select(
        "entity", "unit", F.when(F.col("flag") == "R", "subst").otherwise("goal").alias("event_type"), F.lit("").alias("detail"), F.col("minutes").alias("elapsed")
    )
    return C.exit_events(ev, ["entity", "unit"])


def unit_max(t):
    return t.units().select("unit", F.when(F.col("status").isin("AET", "PEN"), 120.0).otherwise(90.0).alias("max_minutes"))


CTE["blrow"] = """
SELECT exp.entity, exp."window", p.unit AS done, d.minutes, s.unit AS st, x.exit_minute, CASE WHEN u.status IN ('AET','PEN') THEN 120e0 ELSE 90e0 END AS mx FROM exp
LEFT JOIN proc p ON exp.unit=p.unit LEFT JOIN {src} d ON exp.entity=d.entity AND exp.unit=d.unit LEFT JOIN (SELECT DISTINCT entity, unit FROM det WHERE source='startXI') s ON exp.entity=s.entity AND exp.unit=s.unit
LEFT JOIN (SELECT entity, unit, min(least(greatest(minutes,0e0),130e0)) AS exit_minute FROM det WHERE flag='R' GROUP BY ALL) x ON exp.entity=x.entity AND exp.unit=x.unit JOIN u ON exp.unit=u.unit"""
_BL = """
SELECT *, CASE WHEN expected>0 THEN processed*1e0/expected END AS unit_coverage, CASE WHEN dm+mm>0 THEN dm/(dm+mm) ELSE 1e0 END AS lower,
  coalesce(expected>0 AND processed*1e0/expected>=0.8 AND CASE WHEN dm+mm>0 THEN dm/(dm+mm) ELSE 1e0 END>=0.8, false) AS passed FROM (
  SELECT s.entity, s."window", coalesce(b.expected,0) AS expected, coalesce(b.processed,0) AS processed, coalesce(b.du,0) AS du, coalesce(b.dm,0e0) AS dm, coalesce(b.ks,0) AS ks, coalesce(b.ms,0) AS ms, coalesce(b.mm,0e0) AS mm, coalesce(b.mx,0) AS mx
  FROM spine s LEFT JOIN (SELECT entity, "window", count(*) AS expected, count(done) AS processed, count(minutes) AS du, coalesce(sum(minutes),0e0) AS dm, count(st) AS ks, count(*) FILTER (st IS NOT NULL AND minutes IS NULL) AS ms,
    coalesce(sum(CASE WHEN st IS NOT NULL AND minutes IS NULL THEN least(coalesce(exit_minute,mx),mx) END),0e0) AS mm, count(*) FILTER (st IS NOT NULL AND minutes IS NULL AND exit_minute IS NOT NULL) AS mx FROM {rows} GROUP BY ALL) b ON s.entity=b.entity AND s."window"=b."window")"""
_row = CTE["blrow"]
CTE["blrow"] = _row.format(src="pd")
CTE_DEPS["blrow"] = ("exp", "proc", "pd", "det", "u")
CTE["bled"] = _BL.format(rows="blrow")
CTE_DEPS["bled"] = ("spine", "blrow")


def bounded(t, details=None):
    return C.bounded_coverage_ledger(
        entities(t), expected(t), processed(t), pair_details(t) if details is None else details, starters(t), exits(t), unit_max(t), W
    )


_BL_OUT = """entity, "window", expected, processed, du AS detail_units, dm AS detail_minutes, ks AS known_starts, ms AS missing_starts, mm AS missing_minutes_bound, mx AS missing_starts_with_exit, round(unit_coverage,6) AS unit_coverage, round(lower,6) AS minute_coverage_lower, passed"""


def bl_columns(df):
    return df.select(
        "entity", "window", "expected", "processed", "detail_units", "detail_minutes", "known_starts", "missing_starts", "missing_minutes_bound", "missing_starts_with_exit",
        *r6("unit_coverage", "minute_coverage_lower"), "passed",
    )


@query("A8_bounded_coverage_ledger", f"SELECT {_BL_OUT} FROM bled", ("bled",))
def _(t):
    return bl_columns(bounded(t))


@query(
    "K16_merge_minutes",
    """SELECT led.entity, led."window", detail_minutes, greatest(detail_minutes, coalesce(m,0e0)) AS merged_minutes, greatest(detail_units, coalesce(n,0)) AS merged_units, greatest(coalesce(m,0e0)-detail_minutes,0e0) AS recovered_minutes, passed AS passed_before,
  coalesce(unit_coverage>=0.8 AND (led."window"<>'current' OR reported IS NULL OR greatest(detail_minutes,coalesce(m,0e0))/nullif(reported,0)>=0.8), false) AS passed_after
FROM led LEFT JOIN (SELECT entity, w AS "window", count(*) AS n, sum(minutes) AS m FROM (SELECT entity, unit, max(least(minutes,130e0)) AS minutes FROM det GROUP BY ALL) JOIN u USING (unit) JOIN (VALUES ('current'),('pre')) v(w) ON (w='current' AND in_current) OR (w='pre' AND in_pre) WHERE official GROUP BY ALL) c
  ON led.entity=c.entity AND led."window"=c."window" """,
    ("led", "det", "u"),
)
def _(t):
    return C.merge_minutes(ledger(t), t.details().select("entity", "unit", "minutes"), flags(t), WINDOWS, "current")


def evidence(t):
    """Pairs, line-ups, events and unit metadata made from the order lines."""
    li = t.lineitem
    pairs = li.select(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("unit")).distinct()
    lineups = li.where(F.col("l_linenumber") != 7).select(
        F.col("l_orderkey").alias("unit"), F.col("l_suppkey").alias("entity"), (F.col("l_suppkey") % 2).alias("side"),
        F.when(F.col("l_linestatus") == "F", "startXI").otherwise("substitutes").alias("source"),
    )
    events = li.select(
        F.col("l_orderkey").alias("unit"), (F.col("l_suppkey") % 2).alias("side"),
        F.when(F.col("l_returnflag") == "R", "subst").when(F.col("l_returnflag") == "A", "Card").otherwise("Goal").alias("event_type"),
        F.when(F.col("l_linenumber") % 2 == 0, "Red Card").otherwise("Yellow Card").alias("detail"),
        F.when(F.col("l_linenumber") != 5, (F.col("l_quantity") * 2).cast("int")).alias("elapsed"), F.col("l_suppkey").alias("player_id"), (F.col("l_suppkey") + 1).alias("assist_id"),
    )
    meta = t.units().select(
        "unit", "status", F.lit(11).alias("home_starters"), F.when(F.col("official"), 11).otherwise(9).alias("away_starters"), F.col("home_goals").alias("event_count")
    )
    return pairs, lineups, events, meta


CTE["rec"] = """
SELECT entity, unit, CASE WHEN m>0 THEN m END AS minutes, CASE WHEN m>0 THEN CASE WHEN starter AND ex IS NULL THEN 'B' ELSE 'A' END END AS grade, CASE WHEN starter IS NULL THEN 'absent_from_lineup' WHEN m IS NULL OR m<=0 THEN 'insufficient_evidence' END AS reason FROM (
 SELECT *, CASE WHEN starter AND ex IS NOT NULL THEN ex WHEN starter AND status IN ('FT','AET','PEN') AND official AND home_goals>0 AND coalesce(subs,0)>0 THEN mx WHEN NOT starter AND en IS NOT NULL THEN greatest(CASE WHEN ex>=en THEN ex ELSE mx END - en,0e0) END AS m FROM (
  SELECT p.entity, p.unit, s.starter, u.status, u.official, u.home_goals, b.subs, mx, CASE WHEN x.ex IS NOT NULL THEN least(x.ex, mx) END AS ex, CASE WHEN n.en IS NOT NULL THEN least(n.en, mx) END AS en FROM (SELECT DISTINCT entity, unit FROM det) p
  LEFT JOIN (SELECT entity, unit, bool_or(source='startXI') AS starter FROM det WHERE line<>7 GROUP BY ALL) s ON p.entity=s.entity AND p.unit=s.unit
  LEFT JOIN (SELECT *, CASE WHEN status IN ('AET','PEN') THEN 120e0 ELSE 90e0 END AS mx FROM u) u ON p.unit=u.unit
  LEFT JOIN (SELECT entity, unit, CAST(min(minutes*2) AS DOUBLE) AS ex FROM det WHERE line<>5 AND (flag='R' OR (flag='A' AND line%2=0)) GROUP BY ALL) x ON p.entity=x.entity AND p.unit=x.unit
  LEFT JOIN (SELECT entity+1 AS entity, unit, CAST(min(minutes*2) AS DOUBLE) AS en FROM det WHERE line<>5 AND flag='R' GROUP BY ALL) n ON p.entity=n.entity AND p.unit=n.unit
  LEFT JOIN (SELECT unit, entity%2 AS side, count(*) AS subs FROM det WHERE flag='R' GROUP BY ALL) b ON p.unit=b.unit AND p.entity%2=b.side))"""
CTE_DEPS["rec"] = ("det", "u")


@query("K17_reconstruct_exposure", "SELECT entity, unit, minutes, grade, reason FROM rec", ("rec",))
def _(t):
    return C.reconstruct_exposure(*evidence(t)).select("entity", "unit", "minutes", "grade", "reason")


CTE["pdrec"] = """
SELECT unit, entity, max(minutes) AS minutes FROM (SELECT unit, entity, minutes FROM pd UNION ALL SELECT unit, entity, minutes FROM recw) GROUP BY ALL"""
CTE["recw"] = "SELECT r.entity, r.unit, r.minutes FROM rec r WHERE r.minutes IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pd WHERE pd.entity=r.entity AND pd.unit=r.unit)"
CTE_DEPS["recw"] = ("rec", "pd")
CTE_DEPS["pdrec"] = ("pd", "recw")
CTE["blrow3"] = _row.format(src="pdrec")
CTE_DEPS["blrow3"] = ("exp", "proc", "pdrec", "det", "u")
CTE["bled3"] = _BL.format(rows="blrow3")
CTE_DEPS["bled3"] = ("spine", "blrow3")


@query(
    "K18_integrate_reconstructed",
    """SELECT b.entity, b."window", expected, dm AS detail_minutes, round(lower,6) AS minute_coverage_lower, passed, coalesce(m,0e0) AS reconstructed_minutes, coalesce(n,0) AS reconstructed_units, greatest(dm-coalesce(m,0e0),0e0) AS provider_minutes,
  CASE WHEN coalesce(n,0)>0 THEN 'v3_reconstructed' ELSE 'v2_bounded' END AS version
FROM bled3 b LEFT JOIN (SELECT r.entity, e."window", sum(minutes) AS m, count(DISTINCT r.unit) AS n FROM recw r JOIN exp e ON r.entity=e.entity AND r.unit=e.unit GROUP BY ALL) r ON b.entity=r.entity AND b."window"=r."window" """,
    ("bled3", "recw", "exp"),
)
def _(t):
    from ..session import cut_lineage

    have = cut_lineage(pair_details(t))
    rec = cut_lineage(
        C.reconstruct_exposure(*evidence(t)).where(F.col("minutes").isNotNull()).join(have.select("entity", "unit"), ["entity", "unit"], "left_anti").select("entity", "unit", "minutes")
    )
    union = have.unionByName(rec.select("unit", "entity", "minutes"))
    led = bounded(t, union)
    out = C.integrate_reconstructed(led, rec.join(expected(t), ["entity", "unit"]))
    return out.select("entity", "window", "expected", "detail_minutes", *r6("minute_coverage_lower"), "passed", "reconstructed_minutes", "reconstructed_units", "provider_minutes", "version")


def pair_ledger(t):
    d = t.details()
    details = d.where(F.col("flag") == "R").select("entity", "unit", F.when(F.col("line") != 3, F.col("entity") % 2).alias("side"), F.nullif(F.col("minutes"), F.lit(50.0)).alias("minutes"))
    lineups = d.where(F.col("flag") != "A").select("entity", "unit", (F.col("entity") % 3).alias("side"), "source")
    return C.rebuild_pair_ledger(details, lineups, t.units().select("unit", "league", "season"))


CTE["pl"] = """
SELECT k.entity, k.unit, coalesce(ps, ls) AS side, minutes, starter, league, season, coalesce(minutes>0,false) AS detailed, CASE WHEN minutes>0 THEN 'detailed' WHEN starter THEN 'lineup_only_start' ELSE 'no_positive_row' END AS pair_status FROM (
 SELECT entity, unit, min(ps) AS ps, min(ls) AS ls, max(minutes) AS minutes, bool_or(st) AS starter FROM (
  SELECT entity, unit, CASE WHEN line<>3 THEN entity%2 END AS ps, NULL AS ls, nullif(minutes,50) AS minutes, false AS st FROM det WHERE flag='R' UNION ALL SELECT entity, unit, NULL, entity%3, NULL, source='startXI' FROM det WHERE flag<>'A') GROUP BY ALL) k LEFT JOIN u ON k.unit=u.unit"""
CTE_DEPS["pl"] = ("det", "u")


@query("K19_rebuild_pair_ledger", "SELECT entity, unit, side, minutes, starter, league, season, detailed, pair_status FROM pl", ("pl",))
def _(t):
    return pair_ledger(t).select("entity", "unit", "side", "minutes", "starter", "league", "season", "detailed", "pair_status")


@query(
    "K19_pair_summary",
    "SELECT entity, count(*) AS pairs, count(*) FILTER (detailed) AS detailed_pairs, coalesce(sum(minutes),0e0) AS minutes, count(*) FILTER (starter) AS start_pairs, count(*) FILTER (pair_status='lineup_only_start') AS missing_start_pairs FROM pl GROUP BY entity",
    ("pl",),
)
def _(t):
    return C.pair_summary(pair_ledger(t))


@query(
    "K20_minute_ledger_diff",
    """SELECT o.entity, round(old_share,6) AS old_share, round(new_share,6) AS new_share, greatest(om-nm,0e0) AS minutes_not_current, CASE WHEN new_share>=0.35 THEN 'current_passes' WHEN old_share>=0.35 THEN 'only_in_old' ELSE 'both_below' END AS classification FROM (
  SELECT entity, sum(minutes) AS tot, coalesce(sum(minutes) FILTER (flag='R'),0) AS om, coalesce(sum(minutes) FILTER (flag='R'),0)/sum(minutes) AS old_share, coalesce(sum(minutes) FILTER (flag='A'),0) AS nm, coalesce(sum(minutes) FILTER (flag='A'),0)/sum(minutes) AS new_share FROM det GROUP BY entity) o""",
    ("det",),
)
def _(t):
    part = lambda f, tag: t.details().groupBy("entity").agg(
        F.coalesce(F.sum(F.when(F.col("flag") == f, F.col("minutes"))), F.lit(0.0)).alias(f"{tag}_minutes"),
        (F.coalesce(F.sum(F.when(F.col("flag") == f, F.col("minutes"))), F.lit(0.0)) / F.sum("minutes")).alias(f"{tag}_share"),
    )
    out = C.minute_ledger_diff(part("R", "old"), part("A", "new"), threshold=0.35)
    return out.select("entity", *r6("old_share", "new_share"), "minutes_not_current", "classification")


def needed(t):
    r = F.col("s_suppkey") % 4
    reason = F.when(r == 0, "covered_pool_shortage").when(r == 1, "top35_guardrail").when(r == 2, "upper90_can_enter_top30").otherwise("other")
    return t.supplier.where(F.col("s_acctbal") > 3000).select(F.col("s_suppkey").alias("entity"), reason.alias("reason"))


CTE["queue"] = """
SELECT DISTINCT e.entity, e.unit, e."window", reason, gap, CASE reason WHEN 'covered_pool_shortage' THEN 6e0 WHEN 'top35_guardrail' THEN 2.5e0 WHEN 'upper90_can_enter_top30' THEN 3.5e0 ELSE 1e0 END + CASE gap WHEN 'missing_unit' THEN 2e0 ELSE 1.5e0 END AS priority FROM (
  SELECT exp.*, 'missing_unit' AS gap FROM exp WHERE unit NOT IN (SELECT unit FROM proc) UNION ALL
  SELECT exp.*, 'start_without_detail' FROM exp JOIN (SELECT DISTINCT entity, unit FROM det WHERE source='startXI') s ON exp.entity=s.entity AND exp.unit=s.unit WHERE NOT EXISTS (SELECT 1 FROM pd WHERE pd.entity=exp.entity AND pd.unit=exp.unit AND pd.minutes>0)) e
JOIN (SELECT s_suppkey AS entity, CASE s_suppkey%4 WHEN 0 THEN 'covered_pool_shortage' WHEN 1 THEN 'top35_guardrail' WHEN 2 THEN 'upper90_can_enter_top30' ELSE 'other' END AS reason FROM supplier WHERE s_acctbal>3000) n ON e.entity=n.entity"""
CTE_DEPS["queue"] = ("exp", "proc", "pd", "det")


def queues(t):
    return C.residual_queue(needed(t), expected(t), processed(t), starters(t), pair_details(t))


@query("K25_residual_queue", 'SELECT entity, unit, "window", reason, gap, priority FROM queue', ("queue",))
def _(t):
    return queues(t)[0]


@query(
    "K25_residual_units",
    "SELECT unit, count(DISTINCT entity) AS entities, count(*) AS pairs, max(priority) AS max_priority, sum(priority) AS total_priority, max(priority)+0.5*sum(priority) AS information_value FROM queue GROUP BY unit",
    ("queue",),
)
def _(t):
    return queues(t)[1]
