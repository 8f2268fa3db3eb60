"""Scalar, cleaning and flattening queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import flatten as L
from ..plans.ranking import exposure_uncertainty  # noqa: F401
from ..presets.football import ROLE_WEIGHTS
from ..sources.io import normalise_struct
from .base import CTE, CTE_DEPS, query
from .payloads import passing_payloads, unit_payloads
from .windows_q import COHORTS, slim

def encoded():
    """A quantity as text, in an encoding chosen by the line number."""
    n, qty = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    return (
        F.when(n == 1, F.concat(qty, F.lit("%")))
        .when(n == 2, F.concat(F.lit(" "), qty, F.lit(" ")))
        .when(n == 3, "")
        .when(n == 4, "1d")
        .when(n == 5, "n/a")
        .when(n == 6, F.lit(None))
        .otherwise("-2.5e1")
    )


CTE["enc"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE l_linenumber WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '%' WHEN 2 THEN ' ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' '
  WHEN 3 THEN '' WHEN 4 THEN '1d' WHEN 5 THEN 'n/a' WHEN 6 THEN NULL ELSE '-2.5e1' END AS txt FROM lineitem"""


def enc(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", encoded().alias("txt"))


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query(
    "F1_to_number0",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN l_quantity WHEN 2 THEN l_quantity WHEN 7 THEN -25e0 ELSE 0e0 END AS number FROM enc""",
    ("enc",),
)
def _(t):
    return enc(t).select("l_orderkey", "l_linenumber", "l_partkey", X.to_number0("txt").alias("number"))


@query(
    "F2_to_number",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 2 THEN l_quantity WHEN 7 THEN -25e0 END AS number FROM enc""",
    ("enc",),
)
def _(t):
    return enc(t).select("l_orderkey", "l_linenumber", "l_partkey", X.to_number("txt").alias("number"))


@query(
    "F3_to_bool",
    "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_linenumber IN (1,2,3), false) AS flag, l_quantity>25 AS as_is FROM lineitem",
)
def _(t):
    n = F.col("l_linenumber")
    text = F.when(n == 1, " True ").when(n == 2, "1").when(n == 3, "YES").when(n == 4, "no").when(n == 5, F.lit(None)).otherwise("0")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", X.to_bool(text).alias("flag"), X.to_bool(F.col("l_quantity") > 25).alias("as_is"))


@query(
    "F4_safe_ratio",
    """SELECT s_suppkey, round(CASE WHEN a>0 THEN r*1e0/a END,6) AS ratio_null, round(CASE WHEN a>0 THEN r*1e0/a ELSE 0e0 END,6) AS ratio_zero FROM (
  SELECT s_suppkey, count(*) FILTER (l_returnflag='R') AS r, count(*) FILTER (l_returnflag='A' AND l_quantity>49) AS a FROM supplier JOIN lineitem ON s_suppkey=l_suppkey GROUP BY 1)""",
)
def _(t):
    g = t.supplier.join(t.lineitem, F.col("s_suppkey") == F.col("l_suppkey")).groupBy("s_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 49)).alias("a")
    )
    return g.select("s_suppkey", F.round(X.safe_ratio("r", "a"), 6).alias("ratio_null"), F.round(X.safe_ratio("r", "a", zero=True), 6).alias("ratio_zero"))


@query(
    "F5_accurate_count",
    """SELECT l_orderkey, n, l_partkey, round(CASE n WHEN 1 THEN 10*80/100e0 WHEN 2 THEN 15e0 WHEN 3 THEN 30*85/100e0 WHEN 4 THEN 0e0 WHEN 5 THEN 50e0 ELSE n*9e0 END,6) AS accurate FROM pay""",
    ("pay",),
)
def _(t):
    n = F.col("l_linenumber")
    acc = F.when(n == 1, "80%").when(n == 2, "15").when(n == 3, "85").when(n == 4, "").when(n == 5, "200").otherwise((n * 9).cast("string"))
    return t.lineitem.select("l_orderkey", n.alias("n"), "l_partkey", F.round(X.accurate_count(n * 10, acc), 6).alias("accurate"))


CTE["f6"] = """
SELECT l_orderkey AS fixture_id, home_id AS team_id, l_partkey AS player_id, l_quantity AS minutes, CAST(CAST(round(l_discount*100) AS INTEGER) AS DOUBLE) AS provider_rating, n, l_returnflag AS rf, 1 AS first FROM pay
UNION ALL SELECT l_orderkey, home_id, l_partkey, 3e0, 0e0, n, l_returnflag, 0 FROM pay WHERE n % 2 = 0
UNION ALL SELECT l_orderkey, away_id, CASE WHEN n<>7 THEN l_partkey+1 END, l_quantity-25, 6.5e0, n, l_returnflag, 1 FROM pay"""
CTE_DEPS["f6"] = ("pay",)
_ACC = "CASE n WHEN 1 THEN 10*80/100e0 WHEN 2 THEN 15e0 WHEN 3 THEN 30*85/100e0 WHEN 4 THEN 0e0 WHEN 5 THEN 50e0 ELSE n*9e0 END"


@query(
    "F6_flatten_entity_unit",
    f"""SELECT fixture_id, team_id, player_id, minutes, CAST(n AS DOUBLE) AS shots, CASE WHEN rf='R' THEN 1e0 ELSE 0e0 END AS goals, 10e0*n AS passes, round({_ACC},6) AS passes_accurate,
  CASE WHEN rf='A' THEN 1e0 ELSE 0e0 END AS yellow_cards, CASE WHEN n>1 THEN n-1e0 ELSE 0e0 END AS dribbles_completed FROM f6 WHERE first=1 AND minutes>0 AND player_id IS NOT NULL""",
    ("f6",),
)
def _(t):
    return L.flatten_entity_unit(unit_payloads(t, "fixture", "players")).select(
        "fixture_id", "team_id", "player_id", "minutes", "shots", "goals", "passes", F.round("passes_accurate", 6).alias("passes_accurate"), "yellow_cards", "dribbles_completed"
    )


@query(
    "F7_flatten_entity_unit_full",
    """SELECT fixture_id, team_id, player_id, minutes, n AS shots, CASE WHEN n>3 THEN n-3 END AS shots_on, n % 3 AS key_passes, CASE n WHEN 1 THEN '80%' WHEN 2 THEN '15' WHEN 3 THEN '85' WHEN 4 THEN '' WHEN 5 THEN '200' ELSE CAST(n*9 AS VARCHAR) END AS passes_accuracy_raw
FROM f6 WHERE player_id IN (SELECT p_partkey FROM part WHERE p_size>40)""",
    ("f6",),
)
def _(t):
    targets = t.part.where(F.col("p_size") > 40).select(F.col("p_partkey").alias("player_id"))
    out = L.flatten_entity_unit_full(unit_payloads(t, "fixture", "players"), targets)
    return out.select("fixture_id", "team_id", "player_id", "minutes", "shots", "shots_on", "key_passes", "passes_accuracy_raw")


CTE["lu"] = """
SELECT l_orderkey AS fixture_id, team AS team_id, '4-3-3' AS formation, CASE WHEN k<=11 THEN 'startXI' ELSE 'substitutes' END AS lineup_source, team*100+k AS player_id,
  CASE WHEN k=1 THEN 'G' WHEN k<=5 THEN 'D' WHEN k<=8 THEN 'M' ELSE 'F' END AS lineup_position,
  CASE WHEN k=1 THEN '1:1' WHEN k<=5 THEN '2:'||(k-1) WHEN k<=8 THEN '3:'||(k-5) ELSE '4:'||(k-8) END AS grid
FROM (SELECT l_orderkey, home_id AS team, unnest(range(1,14)) AS k FROM pay WHERE n<>1 UNION ALL SELECT l_orderkey, away_id, unnest(range(1,13)) FROM pay WHERE n<>1)"""
CTE_DEPS["lu"] = ("pay",)


@query(
    "F8_flatten_lineups",
    "SELECT team_id, formation, lineup_source, player_id, lineup_position, grid, count(*) AS n, CAST(sum(fixture_id) AS BIGINT) AS key_sum FROM lu GROUP BY ALL",
    ("lu",),
)
def _(t):
    return L.flatten_lineups(unit_payloads(t, "fixture", "lineups")).groupBy("team_id", "formation", "lineup_source", "player_id", "lineup_position", "grid").agg(
        F.count(F.lit(1)).alias("n"), F.sum("fixture_id").alias("key_sum")
    )


CTE["ev"] = """
SELECT l_orderkey AS fixture_id, 'subst' AS event_type, 'Substitution 1' AS detail, qty + CASE WHEN n>4 THEN n ELSE 0 END AS elapsed, l_partkey AS player_id, l_suppkey AS assist_id, CASE WHEN n=2 THEN 'Injury' END AS comments, n FROM pay WHERE n<>1
UNION ALL SELECT l_orderkey, 'Card', CASE l_returnflag WHEN 'R' THEN 'Red Card' WHEN 'A' THEN 'Yellow Card' ELSE 'Second Yellow card' END, CASE WHEN n<>6 THEN qty+90 END, l_partkey, l_suppkey, NULL, n FROM pay WHERE n<>1
UNION ALL SELECT l_orderkey, CASE WHEN n=3 THEN 'Var' ELSE 'Goal' END, CASE WHEN n%2=0 THEN 'Penalty' ELSE 'Normal Goal' END, 60, l_partkey+1, l_suppkey, CASE WHEN n=4 THEN 'Penalty Shootout' END, n FROM pay WHERE n<>1"""
CTE_DEPS["ev"] = ("pay",)


@query(
    "F9_flatten_events",
    """SELECT fixture_id, event_type, detail, elapsed, player_id, assist_id, comments FROM ev WHERE lower(event_type) IN ('subst','card')
  AND (player_id IN (SELECT p_partkey FROM part WHERE p_size>45) OR assist_id IN (SELECT p_partkey FROM part WHERE p_size>45))""",
    ("ev",),
)
def _(t):
    targets = t.part.where(F.col("p_size") > 45).select(F.col("p_partkey").alias("player_id"))
    out = L.target_events(L.flatten_events(unit_payloads(t, "fixture", "events")), targets)
    return out.select("fixture_id", "event_type", "detail", "elapsed", "player_id", "assist_id", "comments")


@query(
    "F10_unit_metadata",
    """SELECT l_orderkey AS fixture_id, short AS status_short, n<>1 AS lineups_present, n<>1 AS events_present, CASE WHEN n<>1 THEN 2 ELSE 0 END AS lineup_team_blocks, CASE WHEN n<>1 THEN 3 ELSE 0 END AS event_count,
  home_id AS home_team_id, away_id AS away_team_id, CASE WHEN n<>1 THEN 11 ELSE 0 END AS home_startxi_count, CASE WHEN n<>1 THEN 11 ELSE 0 END AS away_startxi_count FROM pay""",
    ("pay",),
)
def _(t):
    return L.unit_metadata(unit_payloads(t, "fixture", "teams", "lineups", "events")).drop("status_elapsed")


@query(
    "F11_unit_context",
    """SELECT l_orderkey AS fixture_id, strftime(l_shipdate,'%Y-%m-%dT%H:%M:%SZ') AS api_date, CAST(epoch(l_shipdate) AS BIGINT) AS api_timestamp, CASE WHEN l_returnflag<>'N' THEN 'Ref '||(l_suppkey%7) END AS referee,
  l_suppkey % 16 AS venue_id, 'City '||(l_suppkey%4) AS venue_city, CAST(n % 5 AS BIGINT) AS league_id, 'Team '||home_id AS home_team, 'Team '||away_id AS away_team FROM pay""",
    ("pay",),
)
def _(t):
    return L.unit_context(unit_payloads(t, "fixture", "league", "teams")).select(
        "fixture_id", "api_date", "api_timestamp", "referee", "venue_id", "venue_city", "league_id", "home_team", "away_team"
    )


def spatial(t):
    """Event log with coordinates derived from the events table, and its frames."""
    ev = t.events
    kind = F.when(F.col("event_type") == "view", "Pass").when(F.col("event_type") == "click", "Carry").when(F.col("event_type") == "purchase", "Shot").when(
        F.col("event_type") == "error", "Pressure"
    ).otherwise("Dribble")
    x, y = (F.col("event_id") % 100).cast("double"), (F.col("event_id") % 60).cast("double")
    end = F.array(x + F.col("user_id") % 30, y)
    events = ev.select(
        F.to_date("ts").alias("match_id"), F.col("event_id").alias("id"), F.concat(F.lit("T"), (F.col("user_id") % 2).cast("string")).alias("team"), kind.alias("type"),
        F.when(F.col("event_id") % 11 != 0, F.array(x, y)).alias("location"),
        F.struct(end.alias("end_location"), F.when(F.col("event_id") % 4 == 0, "Incomplete").alias("outcome")).alias("pass"),
        F.struct(end.alias("end_location")).alias("carry"),
        F.struct(F.when(kind == "Shot", F.floor(F.col("value")) / 1000.0).alias("xg")).alias("shot"),
        (F.col("event_id") % 5 == 0).alias("under_pressure"),
    )
    frames = ev.where(F.col("event_type").isin("view", "purchase")).select(
        F.to_date("ts").alias("match_id"), F.col("event_id").alias("event_uuid"),
        F.transform(F.sequence(F.lit(1), (F.col("user_id") % 8 + 1).cast("int")), lambda k: F.struct((k % 2 == 0).alias("teammate"))).alias("freeze_frame"),
    )
    return events, frames


CTE["sp"] = """
SELECT CAST(ts AS DATE) AS match_id, event_id, 'T'||(user_id%2) AS team,
  CASE event_type WHEN 'view' THEN 'Pass' WHEN 'click' THEN 'Carry' WHEN 'purchase' THEN 'Shot' WHEN 'error' THEN 'Pressure' ELSE 'Dribble' END AS type, event_id%5=0 AS under_pressure,
  CASE WHEN event_id%11<>0 THEN CAST(event_id%100 AS DOUBLE) END AS x, CASE WHEN event_id%11<>0 THEN CAST(event_id%60 AS DOUBLE) END AS y,
  CASE WHEN event_type IN ('view','click') THEN CAST(event_id%100 + user_id%30 AS DOUBLE) END AS end_x, CASE WHEN event_id%4=0 THEN 'Incomplete' END AS outcome,
  CASE WHEN event_type='purchase' THEN floor(value)/1000e0 END AS xg, CAST(CASE WHEN event_type IN ('view','purchase') THEN user_id%8+1 ELSE 0 END AS INTEGER) AS visible,
  CAST(CASE WHEN event_type IN ('view','purchase') THEN (user_id%8+1)//2 ELSE 0 END AS INTEGER) AS visible_teammates FROM events"""


@query(
    "F12_flatten_spatial_events",
    "SELECT match_id, event_id, team, type, under_pressure, x, y, end_x, outcome, round(xg,6) AS xg, visible, visible_teammates, visible-visible_teammates AS visible_opponents FROM sp",
    ("sp",),
)
def _(t):
    out = L.flatten_spatial_events(*spatial(t))
    return out.select("match_id", "event_id", "team", "type", "under_pressure", "x", "y", "end_x", "outcome", *r6("xg"), "visible", "visible_teammates", "visible_opponents")


_A24 = """SELECT match_id, team, count(*) FILTER (type='Pass') AS passes, count(*) FILTER (type='Pass' AND outcome IS NULL) AS completed_passes, count(*) FILTER (type='Shot') AS shots,
  round(coalesce(sum(xg),0e0),6) AS xg, count(*) FILTER (type='Pressure') AS pressures, count(*) FILTER (type='Carry') AS carries,
  count(*) FILTER (type IN ('Pass','Carry') AND end_x-x>=15) AS progressive_actions, count(*) FILTER (under_pressure) AS under_pressure, round(avg(CAST(visible AS DOUBLE)),6) AS mean_visible,
  round(count(*) FILTER (type='Pass' AND outcome IS NULL)*1e0/nullif(count(*) FILTER (type='Pass'),0),6) AS completion FROM sp"""


def spatial_features(t, days=None):
    from ..operators.aggregates import spatial_side_features

    rows = L.flatten_spatial_events(*spatial(t))
    if days is not None:
        rows = rows.join(days, "match_id", "left_semi")
    out = spatial_side_features(rows, ["match_id", "team"])
    return out.select(
        "match_id", "team", "passes", "completed_passes", "shots", *r6("xg"), "pressures", "carries", "progressive_actions", "under_pressure", *r6("mean_visible", "completion")
    )


@query("A24_spatial_side_features", _A24 + " GROUP BY ALL", ("sp",))
def _(t):
    return spatial_features(t)


@query(
    "K39_spatial_chain",
    _A24 + " WHERE match_id IN (SELECT match_id FROM (SELECT DISTINCT match_id FROM sp) ORDER BY match_id DESC LIMIT 3) GROUP BY ALL",
    ("sp",),
)
def _(t):
    from ..operators.filters import catalog_select

    days = t.events.select(F.to_date("ts").alias("match_id")).distinct().withColumn("name", F.lit("World Cup"))
    newest = catalog_select(days, "name", "World Cup|Euro", [F.col("match_id").desc()], 3)
    return spatial_features(t, newest)


@query(
    "F13_stats_to_map",
    """SELECT l_orderkey, n, l_partkey, CASE WHEN n<>5 THEN CAST(n AS DOUBLE) END AS total_shots, CASE WHEN n>3 THEN CAST(n AS DOUBLE) END AS on_goal, 55e0 AS possession, CASE WHEN n<>2 THEN 4e0 END AS fouls FROM pay""",
    ("pay",),
)
def _(t):
    n = F.col("l_linenumber")
    item = lambda k, v: F.struct(F.lit(k).alias("type"), v.alias("value"))
    arr = F.array(
        item("Total Shots", F.when(n != 5, n.cast("string"))), item("Shots on Goal", F.when(n > 3, n.cast("string"))),
        item("Ball  Possession", F.lit("55%")), item("Fouls", F.when(n != 2, "4").otherwise("n/a")),
    )
    m = X.stats_map(arr)
    return t.lineitem.select("l_orderkey", n.alias("n"), "l_partkey", m.alias("m")).select(
        "l_orderkey", "n", "l_partkey", X.pick("m", "total shots").alias("total_shots"), X.pick("m", "shots on target", "shots on goal").alias("on_goal"),
        X.pick("m", "ball possession").alias("possession"), X.pick("m", "fouls").alias("fouls"),
    )


@query(
    "F14_null_aware_sum",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(a,0)+coalesce(b,0) END AS total FROM (
  SELECT *, nullif(l_quantity,10) AS a, CASE WHEN l_linenumber>3 THEN CAST(l_linenumber AS DOUBLE) END AS b FROM lineitem)""",
)
def _(t):
    a, b = F.nullif("l_quantity", F.lit(10.0)), F.when(F.col("l_linenumber") > 3, F.col("l_linenumber").cast("double"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", X.null_aware_array_sum(F.array(a, b)).alias("total"))


CTE["evc"] = """
SELECT fixture_id, n, player_id, elapsed, event_type, detail, comments FROM ev WHERE elapsed IS NULL OR elapsed<=130"""
CTE_DEPS["evc"] = ("ev",)


@query(
    "F15_event_class_counts",
    """SELECT CAST(n AS INTEGER) AS n, CAST(coalesce(sum(CAST(event_type='Card' AND detail='Yellow Card' AS INTEGER)),0) AS BIGINT) AS event_yellow_cards,
  CAST(coalesce(sum(CAST(event_type='Card' AND detail IN ('Red Card','Second Yellow card') AS INTEGER)),0) AS BIGINT) AS event_red_cards, CAST(coalesce(sum(CAST(event_type='subst' AS INTEGER)),0) AS BIGINT) AS substitutions,
  CAST(coalesce(sum(CAST(detail='Penalty' AND comments IS NULL AS INTEGER)),0) AS BIGINT) AS penalty_events, CAST(coalesce(sum(CAST(event_type='Var' AS INTEGER)),0) AS BIGINT) AS var_reviews,
  CAST(coalesce(sum(CAST(event_type='subst' AND comments='Injury' AS INTEGER)),0) AS BIGINT) AS observable_injuries FROM (SELECT DISTINCT n FROM pay) LEFT JOIN evc USING (n) GROUP BY n""",
    ("pay", "evc"),
)
def _(t):
    shirt = F.col("players")[0]["players"][0]["statistics"][0]["games"]["number"]
    counted = L.event_class_counts(unit_payloads(t, "players", "events").select(shirt.alias("n"), "events"))
    return counted.groupBy("n").agg(*[F.sum(x).alias(x) for x in L.EVENT_CLASSES])


@query(
    "F16_unit_outcome_row",
    """SELECT l_orderkey AS fixture_id, CASE WHEN n>5 THEN 'Quarter-finals' ELSE 'Group Stage - 1' END AS round, short AS status_short, CAST(CASE WHEN n<>7 THEN n%3 ELSE 0 END + qty%3 AS DOUBLE) AS total_goals_all_periods,
  CAST(n%2 AS DOUBLE) AS halftime_goals, CASE WHEN n<>7 THEN CAST(n%3+qty%3 AS DOUBLE) END AS fulltime_goals, short IN ('AET','PEN') AS extra_time_played, short='PEN' AS shootout_played,
  CASE WHEN n<>5 THEN 2e0*n+2 END AS shots, CASE WHEN n>3 THEN 2e0*n END AS shots_on_target, CASE WHEN n<>2 THEN 8e0 END AS fouls, 6e0 AS corners, CASE WHEN n<>1 AND qty + CASE WHEN n>4 THEN n ELSE 0 END<=130 THEN 1 ELSE 0 END AS substitutions FROM pay""",
    ("pay",),
)
def _(t):
    out = L.unit_outcome_row(passing_payloads(t, *L.OUTCOME_BLOCKS))
    return out.select(
        "fixture_id", "round", "status_short", "total_goals_all_periods", "halftime_goals", "fulltime_goals", "extra_time_played", "shootout_played",
        "shots", "shots_on_target", "fouls", "corners", "substitutions",
    )


@query(
    "F17_coverage_flags",
    "SELECT o_orderkey, year(o_orderdate) IN (1995,1996,1997) AND o_orderstatus='F' AS coverage_events, year(o_orderdate) IN (1995,1996,1997) AND o_totalprice>200000 AS coverage_lineups FROM orders",
)
def _(t):
    season = lambda y: F.struct(
        F.lit(y).alias("year"), F.struct((F.col("o_orderstatus") == "F").alias("events"), (F.col("o_totalprice") > 200000).alias("lineups")).alias("coverage")
    )
    rows = t.orders.withColumn("seasons", F.array(season(1995), season(1996), season(1997)))
    return rows.select("o_orderkey", *X.coverage_flags("seasons", F.year("o_orderdate"), ["events", "lineups"]))


@query(
    "F18_normalise_text",
    r"""SELECT doc_id, lang, length(s) AS slug_length, md5(CASE WHEN s='' THEN 'unknown' ELSE s END) AS slug_md5 FROM (
  SELECT doc_id, lang, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\x00-\x7f]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM documents)""",
)
def _(t):
    s = t.documents.select("doc_id", "lang", X.slug("text").alias("slug"))
    size = F.when(F.col("slug") == "unknown", 0).otherwise(F.length("slug"))
    return s.select("doc_id", "lang", size.alias("slug_length"), F.md5("slug").alias("slug_md5"))


@query(
    "F19_parse_grid",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber<5 THEN l_linenumber END AS grid_row, CASE WHEN l_linenumber<5 THEN CAST(l_partkey%5 AS INTEGER) END AS grid_col FROM lineitem""",
)
def _(t):
    n = F.col("l_linenumber")
    g = F.when(n == 7, F.lit(None)).when(n == 6, F.concat(n.cast("string"), F.lit(":x"))).when(n == 5, "none").otherwise(
        F.concat(n.cast("string"), F.lit(":"), (F.col("l_partkey") % 5).cast("string"))
    )
    p = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", X.parse_grid(g).alias("p"))
    return p.select("l_orderkey", "l_linenumber", "l_partkey", F.col("p.row").alias("grid_row"), F.col("p.col").alias("grid_col"))


@query(
    "F20_parse_ts",
    """SELECT o_orderkey, CASE o_orderkey%4 WHEN 3 THEN NULL WHEN 2 THEN CAST(epoch(o_orderdate)-7200 AS BIGINT) ELSE CAST(epoch(o_orderdate) AS BIGINT) END AS epoch FROM orders""",
)
def _(t):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string")).when(
        k == 2, F.concat(iso, F.lit("+02:00"))
    ).otherwise("not a date")
    return t.orders.select("o_orderkey", F.unix_seconds(X.parse_ts(text)).alias("epoch"))


@query(
    "F21_keyword_flags",
    "SELECT p_partkey, contains(lower(p_name),'red') OR contains(lower(p_name),'old') AS youth, p_size IN (1,2,3) OR contains(lower(p_name),'bolt') AS friendly FROM part",
)
def _(t):
    return t.part.select(
        "p_partkey", X.keyword_flag("p_name", ["red", "old"]).alias("youth"), (F.col("p_size").isin(1, 2, 3) | X.keyword_flag("p_name", ["bolt"])).alias("friendly")
    )


@query(
    "F22_bucketise",
    """SELECT p_partkey, CASE WHEN p_size>=1 AND p_size<=10 THEN 'low' WHEN p_size>10 AND p_size<=30 THEN 'mid' WHEN p_size>30 AND p_size<=49 THEN 'high' END AS right_closed,
  CASE WHEN p_size<24 THEN 'cool' WHEN p_size<29 THEN 'warm' WHEN p_size<35 THEN 'hot' ELSE 'very_hot' END AS left_closed FROM part""",
)
def _(t):
    inf = float("inf")
    return t.part.select(
        "p_partkey", X.bucketise("p_size", [1, 10, 30, 49], ["low", "mid", "high"], include_lowest=True).alias("right_closed"),
        X.bucketise("p_size", [-inf, 24, 29, 35, inf], ["cool", "warm", "hot", "very_hot"], right=False).alias("left_closed"),
    )


@query(
    "F23_per_exposure_rate",
    "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_quantity-10>0 THEN l_linenumber*90e0/(l_quantity-10) ELSE 0e0 END,6) AS p90 FROM lineitem",
)
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(X.per_exposure("l_linenumber", F.col("l_quantity") - 10), 6).alias("p90"))


@query(
    "F24_finite_or_zero",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber IN (1,2,3,4) THEN 0e0 ELSE l_quantity END AS v FROM lineitem",
)
def _(t):
    n = F.col("l_linenumber")
    bad = F.when(n == 1, F.lit(float("nan"))).when(n == 2, F.lit(float("inf"))).when(n == 3, F.lit(float("-inf"))).when(n == 4, F.lit(None)).otherwise(F.col("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", X.finite_or_zero(bad).alias("v"))


@query(
    "F25_clip",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity<>7 THEN least(greatest(l_quantity,10),40) END AS v FROM lineitem",
)
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", X.clip(F.nullif("l_quantity", F.lit(7.0)), 10.0, 40.0).alias("v"))


_DIMS = ("goalkeeping", "build_up", "retention", "defending", "duels", "progression", "creation", "finishing")
_ROLE_OF = {"ECONOMY": "GK", "LARGE": "CB", "MEDIUM": "FB", "PROMO": "CM", "SMALL": "ST", "STANDARD": "W"}


def _sql_weights() -> str:
    parts = []
    for cohort, role in _ROLE_OF.items():
        terms = " + ".join(f"{w!r}*{'0.5e0' if d == 'base' else f'(((p_size+{_DIMS.index(d)}) % 50)/50e0)'}" for d, w in ROLE_WEIGHTS[role].items())
        parts.append(f"WHEN '{cohort}' THEN {terms}")
    return "CASE p_type " + " ".join(parts) + " END"


@query("F26_weighted_composite", f"SELECT p_partkey, round(CASE WHEN p_size<>9 THEN {_sql_weights()} END,6) AS score FROM part")
def _(t):
    role = None
    for cohort, r in _ROLE_OF.items():
        role = F.when(F.col("p_type") == cohort, r) if role is None else role.when(F.col("p_type") == cohort, r)
    size = F.nullif("p_size", F.lit(9))
    rows = t.part.select("p_partkey", role.alias("role"), *[(((size + i) % 50) / 50.0).alias(d) for i, d in enumerate(_DIMS)])
    return rows.select("p_partkey", F.round(X.weighted_composite("role", ROLE_WEIGHTS), 6).alias("score"))


@query("F27_logistic_unit", "SELECT p_partkey, round(1e0/(1e0+exp(-least(greatest((p_size-25)/2e0,-8e0),8e0))),6) AS v FROM part")
def _(t):
    return t.part.select("p_partkey", F.round(X.logistic_unit((F.col("p_size") - 25) / 2.0), 6).alias("v"))


@query(
    "F28_reason_precedence",
    "SELECT p_partkey, CASE WHEN p_size>45 THEN 'guardrail' WHEN p_retailprice>950 THEN 'real' WHEN p_size<10 THEN 'top30' ELSE 'other' END AS reason FROM part",
)
def _(t):
    rules = [(F.col("p_size") > 45, "guardrail"), (F.col("p_retailprice") > 950, "real"), (F.col("p_size") < 10, "top30")]
    return t.part.select("p_partkey", X.reason_precedence(rules, "other").alias("reason"))


@query(
    "F29_outcome_label",
    """SELECT unit, CASE WHEN home_goals>away_goals THEN 'H' WHEN home_goals=away_goals THEN 'D' ELSE 'A' END AS outcome, home_goals||'-'||away_goals AS score,
  CASE WHEN home_goals>away_goals THEN CAST(home AS VARCHAR) WHEN home_goals<away_goals THEN CAST(away AS VARCHAR) ELSE 'draw' END AS winner FROM u""",
    ("u",),
)
def _(t):
    s = lambda x: F.col(x).cast("string")
    return t.units().select(
        "unit", X.outcome_label("home_goals", "away_goals").alias("outcome"), X.scoreline("home_goals", "away_goals").alias("score"),
        X.winner("home_goals", "away_goals", s("home"), s("away")).alias("winner"),
    )


@query(
    "F30_normalise_struct",
    "SELECT l_orderkey AS fixture_id, l_partkey AS fixture_line_part, CAST(l_linenumber AS INTEGER) AS fixture_line_no, l_quantity AS amount FROM lineitem",
)
def _(t):
    nested = t.lineitem.select(
        F.struct(F.col("l_orderkey").alias("id"), F.struct(F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("no")).alias("line")).alias("fixture"), F.col("l_quantity").alias("amount")
    )
    return normalise_struct(nested)


@query(
    "F31_to_local_time",
    """SELECT event_id, strftime(CASE user_id%2 WHEN 0 THEN (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' ELSE (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo' END,'%Y-%m-%d %H:%M:%S') AS local FROM events""",
)
def _(t):
    zone = F.when(F.col("user_id") % 2 == 0, "America/New_York").otherwise("Asia/Tokyo")
    return t.events.select("event_id", F.date_format(X.to_local(F.col("ts").cast("timestamp"), zone), "yyyy-MM-dd HH:mm:ss").alias("local"))


@query(
    "F32_extract_year",
    "SELECT o_orderkey, CASE WHEN o_orderkey%3=0 THEN 0 ELSE CAST(year(o_orderdate) AS INTEGER) END AS yr FROM orders",
)
def _(t):
    name = F.when(F.col("o_orderkey") % 3 == 0, "no year").otherwise(F.concat(F.lit("Season "), F.date_format("o_orderdate", "yyyy"), F.lit("/"), F.lit("xx")))
    return t.orders.select("o_orderkey", X.extract_year(name).alias("yr"))
