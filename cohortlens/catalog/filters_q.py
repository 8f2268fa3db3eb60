"""Filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as P
from ..operators.aggregates import endpoint_rates
from .aggregates_q import WINDOWS
from .base import query


@query(
    "P1_completed_until",
    "SELECT unit, status, ts FROM u WHERE status IN ('FT','AET','PEN') AND ts <= TIMESTAMP '1998-06-30'",
    ("u",),
)
def _(t):
    return P.completed_until(t.units(), ["FT", "AET", "PEN"], F.lit("1998-06-30").cast("timestamp_ntz")).select("unit", "status", "ts")


@query(
    "P2_eligibility_flags",
    """SELECT entity, minutes, round(share,6) AS share, minutes>=700 AND share>=0.8 AS rank_entry, minutes>=900 AND share>=0.8 AS benchmark FROM (
  SELECT entity, sum(minutes) AS minutes, sum(CASE WHEN rating>0 THEN minutes ELSE 0e0 END)/sum(minutes) AS share FROM eu GROUP BY entity)""",
    ("eu",),
)
def _(t):
    per = t.entity_units().groupBy("entity").agg(
        F.sum("minutes").alias("minutes"),
        (F.sum(F.when(F.col("rating") > 0, F.col("minutes")).otherwise(0.0)) / F.sum("minutes")).alias("share"),
    )
    out = P.eligibility_flags(per, "minutes", "share", {"rank_entry": (700.0, 0.8), "benchmark": (900.0, 0.8)})
    return out.withColumn("share", F.round("share", 6))


@query(
    "P3_unit_inventory",
    """SELECT unit, league, season, official, in_current, in_pre FROM u WHERE status IN ('FT','AET','PEN') AND (in_current OR in_pre) AND (league, season) IN (SELECT league, season FROM u WHERE official GROUP BY ALL HAVING count(*)>=1)
  AND (home_id IN (SELECT c_custkey FROM customer WHERE c_acctbal>0) OR away_id IN (SELECT c_custkey FROM customer WHERE c_acctbal>0))""",
    ("u",),
)
def _(t):
    u = t.units()
    covered = u.where("official").select("league", "season").distinct()
    tracked = t.customer.where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("side"))
    return P.unit_inventory(u, covered, tracked).select("unit", "league", "season", "official", "in_current", "in_pre")


@query(
    "P4_appeared",
    """SELECT cohort, count(*) AS n, count(*) FILTER (a) AS appeared, count(*) FILTER (NOT a) AS unused FROM (
  SELECT cohort, coalesce(nullif(minutes,1),0)>0 OR goals<>0 OR red<>0 OR nullif(rating,0) IS NOT NULL OR saves=1 AS a FROM eu) GROUP BY cohort""",
    ("eu",),
)
def _(t):
    a = P.appeared(
        F.nullif("minutes", F.lit(1.0)), [F.col("goals"), F.col("red")], F.nullif("rating", F.lit(0.0)), F.col("saves") == 1
    )
    return t.entity_units().withColumn("a", a).groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("a").alias("appeared"), F.count_if(~F.col("a")).alias("unused")
    )


@query(
    "P5_window_membership",
    """SELECT unit, 'current' AS "window" FROM u WHERE in_current UNION ALL SELECT unit, 'pre' FROM u WHERE in_pre""",
    ("u",),
)
def _(t):
    return P.window_membership(t.units().select("unit", *WINDOWS.values()), WINDOWS).select("unit", "window")


@query(
    "P6_complete_pair_evidence",
    """SELECT unit, coalesce(n,0) AS starters, status IN ('FT','AET') AND coalesce(n,0)>=3 AS partial, coalesce(n*4>=11 AND n*4>=11 AND status IN ('FT','AET','PEN') AND official, false) AS complete
FROM u LEFT JOIN (SELECT unit, count(DISTINCT entity) AS n FROM det WHERE source='startXI' GROUP BY unit) USING (unit)""",
    ("u", "det"),
)
def _(t):
    starters = t.details().where(F.col("source") == "startXI").groupBy("unit").agg(F.countDistinct("entity").alias("n"))
    rows = t.units().join(starters, "unit", "left")
    n = F.col("n") * 4
    return rows.select(
        "unit",
        F.coalesce("n", F.lit(0)).alias("starters"),
        (F.col("status").isin("FT", "AET") & (F.coalesce("n", F.lit(0)) >= 3)).alias("partial"),
        P.complete_pair_evidence(n, n, F.col("official"), F.col("status")).alias("complete"),
    )


@query(
    "P7_unsupported_units",
    """SELECT unit, u.league, u.season, coalesce(r.rate=0,false) AS unsupported FROM u LEFT JOIN (
  SELECT league, season, avg(CASE WHEN home_goals=3 AND away_goals=3 AND league<>2 THEN 1e0 ELSE 0e0 END) AS rate FROM u WHERE season<>1995 GROUP BY ALL) r ON u.league=r.league AND u.season=r.season""",
    ("u",),
)
def _(t):
    u = t.units()
    hit = (F.col("home_goals") == 3) & (F.col("away_goals") == 3) & (F.col("league") != 2)
    rates = endpoint_rates(u.where(F.col("season") != 1995), ["league", "season"], {"hit": hit})
    return P.split_unsupported(u.select("unit", "league", "season"), rates, "hit_rate").select("unit", "league", "season", "unsupported")


@query(
    "P8_entities_without_rows",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='F')",
)
def _(t):
    rows = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return P.entities_without_rows(t.customer.select("c_custkey"), rows, "c_custkey")


@query(
    "P9_catalog_select",
    "SELECT p_partkey, p_name, p_size FROM part WHERE regexp_matches(p_name, '^(red|blue) .*(bolt|gear)') ORDER BY p_size DESC, p_partkey LIMIT 12",
)
def _(t):
    out = P.catalog_select(t.part, "p_name", "^(red|blue) .*(bolt|gear)", [F.col("p_size").desc(), F.col("p_partkey")], 12)
    return out.select("p_partkey", "p_name", "p_size")
