"""Join and context queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import normalise_text
from ..operators import joins as J
from ..operators.flatten import OUTCOME_BLOCKS
from ..operators.tables import literal_table
from ..plans import context
from .aggregates_q import WINDOWS
from .base import CTE, CTE_DEPS, query
from .payloads import passing_payloads
from .windows_q import slim


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("J1_validated_join", "SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN nation ON c_nationkey=n_nationkey AND n_regionkey<>4")
def _(t):
    right = t.nation.where(F.col("n_regionkey") != 4).select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return J.validated_join(t.customer.select("c_custkey", "c_nationkey"), right, ["c_nationkey"])


CTE["exp"] = """
SELECT DISTINCT a.entity, w.w AS "window", s.unit FROM assoc a JOIN (
  SELECT unit, league, season, in_current, in_pre, home_id AS side FROM u WHERE official UNION ALL SELECT unit, league, season, in_current, in_pre, away_id FROM u WHERE official) s
ON a.league=s.league AND a.season=s.season AND a.side=s.side JOIN (VALUES ('current'),('pre')) w(w) ON (w.w='current' AND s.in_current) OR (w.w='pre' AND s.in_pre)"""
CTE_DEPS["exp"] = ("assoc", "u")


def expected(t):
    return J.expected_units(t.units(), t.associations(), WINDOWS)


@query("J2_expected_units", 'SELECT entity, "window", unit FROM exp', ("exp",))
def _(t):
    return expected(t)


@query(
    "J3_set_coverage",
    """SELECT entity, "window", count(*) AS expected, count(p.unit) AS processed, count(*)-count(p.unit) AS missing, round(count(p.unit)*1e0/count(*),6) AS coverage
FROM exp LEFT JOIN (SELECT unit FROM u WHERE status<>'NS') p ON exp.unit=p.unit GROUP BY ALL""",
    ("exp",),
)
def _(t):
    processed = t.units().where(F.col("status") != "NS").select("unit")
    out = J.set_coverage(expected(t), processed, ["entity", "window"])
    return out.withColumn("coverage", F.round("coverage", 6))


@query("J4_target_filter", "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size=1)")
def _(t):
    ids = t.part.where(F.col("p_size") == 1).select(F.col("p_partkey").alias("l_partkey"))
    return J.target_filter(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity"), ids, ["l_partkey"])


@query("J5_exclude_done", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus='F')")
def _(t):
    done = t.lineitem.where(F.col("l_linestatus") == "F").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.exclude_done(t.orders.select("o_orderkey"), done, ["o_orderkey"])


@query(
    "J6_side_target_union",
    """SELECT unit, count(*) AS targets, count(*) FILTER (entity IN (SELECT s_suppkey FROM supplier WHERE s_acctbal>5000)) AS benchmark_targets FROM (
  SELECT DISTINCT s.unit, a.entity FROM (SELECT unit, league, season, home_id AS side FROM u UNION ALL SELECT unit, league, season, away_id FROM u) s JOIN assoc a ON a.league=s.league AND a.season=s.season AND a.side=s.side) GROUP BY unit""",
    ("u", "assoc"),
)
def _(t):
    bench = t.supplier.where(F.col("s_acctbal") > 5000).select(F.col("s_suppkey").alias("entity"))
    return J.side_target_union(t.units(), t.associations(), bench)


@query(
    "J7_interval_join",
    """SELECT e.event_id AS error_id, v.event_id AS other_id FROM events e JOIN events v ON e.user_id=v.user_id AND v.ts BETWEEN e.ts AND e.ts + INTERVAL 4 HOUR WHERE e.event_type='error' AND v.event_type<>'error'""",
)
def _(t):
    e = t.events.where(F.col("event_type") == "error").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").cast("timestamp").alias("t0"))
    v = t.events.where(F.col("event_type") != "error").select("user_id", F.col("event_id").alias("other_id"), F.col("ts").cast("timestamp").alias("ts"))
    out = J.interval_join(e, v, ["user_id"], F.col("t0"), F.col("t0") + F.make_dt_interval(hours=F.lit(4)), "ts")
    return out.select("error_id", "other_id")


@query(
    "J7_interval_mixed",
    """SELECT e.event_id AS error_id, count(*) AS n, min(v.event_id) AS first_id, CAST(sum(v.event_id) AS BIGINT) AS id_sum FROM events e JOIN events v ON e.user_id=v.user_id AND v.event_type<>'error'
  AND v.ts BETWEEN e.ts AND e.ts + CASE e.event_id%5 WHEN 0 THEN INTERVAL 1 MINUTE WHEN 1 THEN INTERVAL 4 HOUR WHEN 2 THEN INTERVAL 9 DAY WHEN 3 THEN INTERVAL 200 DAY ELSE INTERVAL 3650 DAY END
WHERE e.event_type='error' GROUP BY e.event_id""",
)
def _(t):
    # Intervals of a minute to ten years in one join.
    hours = F.element_at(F.array(*[F.lit(x) for x in (1 / 60, 4.0, 216.0, 4800.0, 87600.0)]), (F.col("error_id") % 5 + 1).cast("int"))
    e = t.events.where(F.col("event_type") == "error").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").cast("timestamp").alias("t0"))
    v = t.events.where(F.col("event_type") != "error").select("user_id", F.col("event_id").alias("other_id"), F.col("ts").cast("timestamp").alias("ts"))
    out = J.interval_join(e, v, ["user_id"], F.col("t0"), F.col("t0") + F.make_dt_interval(secs=F.round(hours * 3600, 6).cast("decimal(18,6)")), "ts")
    return out.groupBy("error_id").agg(F.count(F.lit(1)).alias("n"), F.min("other_id").alias("first_id"), F.sum("other_id").alias("id_sum"))


@query(
    "J8_asof_nearest",
    """SELECT purchase_id, right_id, round(value,6) AS value FROM (
  SELECT p.event_id AS purchase_id, v.event_id AS right_id, v.value, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(v.ts)-epoch_us(p.ts)), v.ts, v.event_id) AS rn
  FROM events p JOIN events v ON p.user_id=v.user_id WHERE p.event_type='purchase' AND v.event_type='view') WHERE rn=1""",
)
def _(t):
    p = t.events.where(F.col("event_type") == "purchase").select("user_id", F.col("ts").alias("t"), F.col("event_id").alias("purchase_id"))
    v = t.events.where(F.col("event_type") == "view").select("user_id", F.col("ts").alias("vt"), F.col("event_id").alias("view_id"), "value")
    out = J.asof_nearest(p, v, ["user_id"], "t", "vt", "purchase_id", "view_id", ["value"])
    return out.where(F.col("right_id").isNotNull()).select("purchase_id", "right_id", *r6("value"))


ALIASES = [("red", "RED"), ("red bolt", "RED_BOLT"), ("bolt", "BOLT"), ("small", "SMALL"), ("blue gear", "BLUE_GEAR"), ("gizmo", "GIZMO")]


@query(
    "J9_longest_alias_match",
    "SELECT p_partkey, p_name, max_by(label, length(alias)*1000 - ascii(alias)) AS match FROM part LEFT JOIN (VALUES "
    + ", ".join(f"('{a}','{b}')" for a, b in ALIASES)
    + ") v(alias,label) ON contains(p_name, alias) GROUP BY ALL",
)
def _(t):
    registry = literal_table(t.spark, [("alias", "string"), ("label", "string")], ALIASES)
    return J.longest_alias_match(t.part, "p_name", "p_partkey", registry)


@query(
    "J9_alias_registry",
    """WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part),
reg AS (SELECT DISTINCT alias, replace(upper(alias), ' ', '_') AS label FROM (SELECT w[1]||' '||w[2] AS alias FROM w WHERE p_partkey%2=0 UNION ALL SELECT w[2] FROM w WHERE p_partkey%3=0) WHERE alias IS NOT NULL)
SELECT p_partkey, p_name, arg_min(label, (-length(alias), alias)) AS match FROM part LEFT JOIN reg ON contains(p_name, alias) GROUP BY ALL""",
)
def _(t):
    # The registry is a table: pairs of words of even parts, second words of every third.
    words = F.split("p_name", " ")
    two = t.part.where(F.col("p_partkey") % 2 == 0).select(F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1))).alias("alias"))
    one = t.part.where(F.col("p_partkey") % 3 == 0).select(F.get(words, F.lit(1)).alias("alias"))
    registry = two.unionAll(one).distinct().withColumn("label", F.replace(F.upper("alias"), F.lit(" "), F.lit("_")))
    return J.longest_alias_match(t.part, "p_name", "p_partkey", registry)


@query(
    "J10_best_candidate",
    """SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(c_mktsegment='BUILDING' AS INTEGER) DESC, CAST(c_acctbal>0 AS INTEGER) DESC, floor(c_acctbal/1000) DESC, c_custkey) AS rn FROM customer) WHERE rn=1""",
)
def _(t):
    score = [(F.col("c_mktsegment") == "BUILDING").cast("int"), (F.col("c_acctbal") > 0).cast("int"), F.floor(F.col("c_acctbal") / 1000)]
    return J.best_candidate(t.customer, ["c_nationkey"], score, "c_custkey").select("c_nationkey", "c_custkey")


@query(
    "J11_alias_join",
    "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey=n_nationkey AND n_regionkey<>3",
)
def _(t):
    names = t.nation.where(F.col("n_regionkey") != 3)
    registry = names.select(F.concat_ws("|", F.col("n_name"), F.concat(F.lit("País Ñ-"), F.col("n_nationkey").cast("string"))).alias("aliases"), "n_name", F.col("n_nationkey").alias("seq"))
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))).otherwise(F.concat(F.lit("PAIS n "), F.col("c_nationkey").cast("string")))
    rows = t.customer.select("c_custkey", text.alias("text"))
    return J.alias_join(rows, "text", registry, "aliases", "n_name", "seq").select("c_custkey", "n_name")


CTE["cand3"] = """
SELECT cohort AS role, entity FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY shots DESC, entity) AS rn FROM w0) WHERE rn<=CASE WHEN cohort IN ('ECONOMY','SMALL') THEN 1 ELSE 3 END"""
CTE_DEPS["cand3"] = ("w0",)


def candidates3(t):
    from ..operators.windows import top_n_per_group

    top = top_n_per_group(slim(t), ["cohort"], [F.col("shots").desc(), F.col("entity")], 3, rank="rn")
    keep = F.when(F.col("cohort").isin("ECONOMY", "SMALL"), F.col("rn") <= 1).otherwise(F.lit(True))
    return top.where(keep).select(F.col("cohort").alias("role"), "entity")


_PRODUCT_SQL = """combos AS (SELECT row_number() OVER (ORDER BY a.entity,b.entity,c.entity,d.entity,e.entity,f.entity) AS combination, a.entity AS e1, b.entity AS e2, c.entity AS e3, d.entity AS e4, e.entity AS e5, f.entity AS e6
  FROM cand3 a, cand3 b, cand3 c, cand3 d, cand3 e, cand3 f WHERE a.role='ECONOMY' AND b.role='LARGE' AND c.role='MEDIUM' AND d.role='PROMO' AND e.role='SMALL' AND f.role='STANDARD')
SELECT combination, 'ECONOMY' AS role, e1 AS entity FROM combos UNION ALL SELECT combination, 'LARGE', e2 FROM combos UNION ALL SELECT combination, 'MEDIUM', e3 FROM combos
UNION ALL SELECT combination, 'PROMO', e4 FROM combos UNION ALL SELECT combination, 'SMALL', e5 FROM combos UNION ALL SELECT combination, 'STANDARD', e6 FROM combos"""


@query("J12_identified_set_product", "WITH " + _PRODUCT_SQL, ("cand3",))
def _(t):
    from ..session import cut_lineage

    return J.combinations(t.spark, cut_lineage(candidates3(t)), "role", "entity")


@query(
    "J13_full_outer_reconcile",
    """SELECT entity, unit, minutes_a, minutes_b, coalesce(minutes_a,0)-coalesce(minutes_b,0) AS difference, minutes_a IS NULL OR minutes_b IS NULL OR abs(minutes_a-minutes_b)>5 AS unresolved FROM (
  SELECT entity, unit, sum(minutes) AS minutes_a FROM det WHERE source='startXI' GROUP BY ALL) FULL JOIN (SELECT entity, unit, sum(minutes) AS minutes_b FROM det WHERE flag<>'N' GROUP BY ALL) USING (entity, unit)""",
    ("det",),
)
def _(t):
    d = t.details()
    a = d.where(F.col("source") == "startXI").groupBy("entity", "unit").agg(F.sum("minutes").alias("minutes"))
    b = d.where(F.col("flag") != "N").groupBy("entity", "unit").agg(F.sum("minutes").alias("minutes"))
    return J.full_outer_reconcile(a, b, ["entity", "unit"], "minutes", 5.0)


@query(
    "J14_coalesced_lookup",
    """SELECT s_suppkey AS entity, coalesce(a.m, b.m, c.m) AS minutes, coalesce(a.n, b.n, c.n) AS line FROM supplier
LEFT JOIN (SELECT entity, max(minutes) AS m, NULL AS n FROM det WHERE source='startXI' AND minutes>49 GROUP BY 1) a ON s_suppkey=a.entity
LEFT JOIN (SELECT entity, max(minutes) AS m, max(line) AS n FROM det WHERE flag='R' AND minutes<3 GROUP BY 1) b ON s_suppkey=b.entity
LEFT JOIN (SELECT entity, min(minutes) AS m, min(line) AS n FROM det GROUP BY 1) c ON s_suppkey=c.entity""",
    ("det",),
)
def _(t):
    d = t.details()
    a = d.where((F.col("source") == "startXI") & (F.col("minutes") > 49)).groupBy("entity").agg(F.max("minutes").alias("minutes"), F.lit(None).cast("int").alias("line"))
    b = d.where((F.col("flag") == "R") & (F.col("minutes") < 3)).groupBy("entity").agg(F.max("minutes").alias("minutes"), F.max("line").alias("line"))
    c = d.groupBy("entity").agg(F.min("minutes").alias("minutes"), F.min("line").alias("line"))
    return J.coalesced_lookup(t.supplier.select(F.col("s_suppkey").alias("entity")), [a, b, c], ["entity"], ["minutes", "line"])


CTE["x"] = "SELECT entity, sum(minutes) AS minutes, count(*) AS units, count(*) FILTER (source='startXI') AS starts FROM det GROUP BY entity"
CTE_DEPS["x"] = ("det",)


@query(
    "J15_frozen_delta",
    """SELECT 'minutes' AS "check", max(abs(a.minutes-b.minutes)) AS max_delta, max(abs(a.minutes-b.minutes))<=1e-12 AS passed FROM x a JOIN x b USING (entity)
UNION ALL SELECT 'units', CAST(max(abs(a.units-b.starts)) AS DOUBLE), max(abs(a.units-b.starts))<=1e-12 FROM x a JOIN x b USING (entity)""",
    ("x",),
)
def _(t):
    g = t.details().groupBy("entity").agg(
        F.sum("minutes").alias("minutes"), F.count(F.lit(1)).cast("double").alias("units"), F.count_if(F.col("source") == "startXI").cast("double").alias("starts")
    )
    before = g.select("entity", "minutes", F.col("starts").alias("units"))
    return J.frozen_delta(before, g.select("entity", "minutes", "units"), ["entity"], ["minutes", "units"], 1e-12)


@query(
    "J16_repair_missing_only",
    """SELECT o_orderkey, CASE WHEN o_orderstatus='P' THEN coalesce(m, o_totalprice) ELSE o_totalprice END AS o_totalprice, o_orderstatus='P' AND m IS NOT NULL AS repaired
FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS m FROM lineitem GROUP BY 1) r ON o_orderkey=l_orderkey""",
)
def _(t):
    repair = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("o_totalprice"))
    table = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    return J.repair_missing_only(table, repair, ["o_orderkey"], ["o_totalprice"], F.col("o_orderstatus") == "P").drop("o_orderstatus")


_BM = ("total_goals_all_periods", "shots", "shots_on_target", "corners")
CTE["bm"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY total_goals_all_periods DESC NULLS LAST, shots DESC NULLS LAST, shots_on_target DESC NULLS LAST) AS rn FROM (
 SELECT l_orderkey AS fixture_id, CAST(CASE WHEN n<>7 THEN n%3 ELSE 0 END + qty%3 AS DOUBLE) AS total_goals_all_periods, CASE WHEN n<>5 THEN 2e0*n+2 END AS shots, CASE WHEN n>3 THEN 2e0*n END AS shots_on_target, 6e0 AS corners FROM pay)) WHERE rn=1"""
CTE_DEPS["bm"] = ("pay",)


@query(
    "K32_event_benchmark",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, count({m}) AS n, round(avg(CASE WHEN {m} IS NOT NULL THEN 1e0 ELSE 0e0 END),6) AS coverage, round(avg({m}),6) AS mean, round(stddev_samp({m}),6) AS sd,
  quantile_cont({m},0.05) AS p05, quantile_cont({m},0.5) AS p50, quantile_cont({m},0.95) AS p95, min({m}) AS min, max({m}) AS max FROM bm"""
        for m in _BM
    ),
    ("bm",),
)
def _(t):
    order = [F.col(x).desc_nulls_last() for x in ("total_goals_all_periods", "shots", "shots_on_target")]
    summary, _gate = context.event_benchmark(passing_payloads(t, *OUTCOME_BLOCKS), order, list(_BM), ["shots", "corners"])
    return summary.select("metric", "n", *r6("coverage", "mean", "sd"), "p05", "p50", "p95", "min", "max")


def weather_inputs(t):
    """Purchases as units at one of eight places; views and clicks as grade A hours,
    errors as grade B hours."""
    ev = t.events
    units = ev.where(F.col("event_type") == "purchase").select(F.col("event_id").alias("unit"), (F.col("user_id") % 97).alias("place"), F.col("ts").cast("timestamp").alias("kickoff"))
    hours = ev.where(F.col("event_type").isin("view", "click", "error")).select(
        (F.col("user_id") % 97).alias("place"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("time"),
        F.when(F.col("event_type") == "error", "B").otherwise("A").alias("grade"), F.floor("value").cast("double").alias("temperature"),
        (F.col("event_id") % 4).cast("double").alias("rain"), (F.col("event_id") % 3).cast("int").alias("code"),
    )
    return units, hours


CTE["wu"] = "SELECT event_id AS unit, user_id%97 AS place, ts AS kickoff FROM events WHERE event_type='purchase'"
CTE["wh"] = """SELECT user_id%97 AS place, date_trunc('hour', ts) AS time, CASE WHEN event_type='error' THEN 'B' ELSE 'A' END AS grade, floor(value) AS temperature, CAST(event_id%4 AS DOUBLE) AS rain, CAST(event_id%3 AS INTEGER) AS code
FROM events WHERE event_type IN ('view','click','error')"""
CTE["whit"] = """
SELECT unit, grade, temperature, rain, code FROM (SELECT wu.unit, wh.*, min(grade) OVER (PARTITION BY unit) AS g FROM wu JOIN wh ON wu.place=wh.place AND wh.time BETWEEN date_trunc('hour',kickoff) AND date_trunc('hour',kickoff)+INTERVAL 4 HOUR) WHERE grade=g"""
CTE_DEPS["whit"] = ("wu", "wh")


@query(
    "K33_weather_record",
    """SELECT wu.unit, coalesce(s.grade,'unavailable') AS grade, s.window_hours, round(s.tm,6) AS temperature_mean, s.tx AS temperature_max, s.rs AS rain_sum, m.code AS code_mode,
  CASE WHEN s.tx<24 THEN 'cool_or_mild' WHEN s.tx<29 THEN 'warm' WHEN s.tx<35 THEN 'hot' WHEN s.tx>=35 THEN 'very_hot' END AS heat_band
FROM wu LEFT JOIN (SELECT unit, max(grade) AS grade, count(*) AS window_hours, avg(temperature) AS tm, max(temperature) AS tx, sum(rain) AS rs FROM whit GROUP BY unit) s ON wu.unit=s.unit
LEFT JOIN (SELECT unit, code FROM (SELECT unit, code, row_number() OVER (PARTITION BY unit ORDER BY k DESC, code) AS rn FROM (SELECT unit, code, count(*) AS k FROM whit GROUP BY ALL)) WHERE rn=1) m ON wu.unit=m.unit""",
    ("whit", "wu"),
)
def _(t):
    out = context.weather_record(*weather_inputs(t))
    return out.select("unit", "grade", "window_hours", *r6("temperature_mean"), "temperature_max", "rain_sum", "code_mode", "heat_band")


@query(
    "J8_pre_window",
    """SELECT unit, round(avg(temperature),6) AS pre_temperature_mean, sum(rain) AS pre_rain_sum, max(temperature) AS pre_temperature_max FROM wu JOIN wh ON wu.place=wh.place AND wh.time BETWEEN kickoff-INTERVAL 3 HOUR AND kickoff GROUP BY unit""",
    ("wu", "wh"),
)
def _(t):
    return context.pre_window(*weather_inputs(t)).select("unit", *r6("pre_temperature_mean"), "pre_rain_sum", "pre_temperature_max")
