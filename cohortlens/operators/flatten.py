"""Nested unit payloads to rows: explode and nested field access only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import accurate_count, event_minute, normalise_key, null_aware_sum, pick_entry, stats_entries, to_number0

# Output column -> field of a statistics element.
COUNTER_PATHS = (
    ("shots", "shots.total"),
    ("shots_on", "shots.on"),
    ("goals", "goals.total"),
    ("goals_conceded", "goals.conceded"),
    ("assists", "goals.assists"),
    ("saves", "goals.saves"),
    ("passes", "passes.total"),
    ("key_passes", "passes.key"),
    ("tackles", "tackles.total"),
    ("blocks", "tackles.blocks"),
    ("interceptions", "tackles.interceptions"),
    ("duels", "duels.total"),
    ("duels_won", "duels.won"),
    ("dribbles_attempted", "dribbles.attempts"),
    ("dribbles_completed", "dribbles.success"),
    ("fouls_drawn", "fouls.drawn"),
    ("fouls_committed", "fouls.committed"),
    ("yellow_cards", "cards.yellow"),
    ("red_cards", "cards.red"),
)
RAW_PATHS = (
    ("number", "games.number"),
    ("provider_position", "games.position"),
    ("rating", "games.rating"),
    ("captain", "games.captain"),
    ("substitute", "games.substitute"),
    ("offsides", "offsides"),
    ("passes_accuracy_raw", "passes.accuracy"),
    ("penalty_won", "penalty.won"),
    ("penalty_committed", "penalty.commited"),
    ("penalty_scored", "penalty.scored"),
    ("penalty_missed", "penalty.missed"),
    ("penalty_saved", "penalty.saved"),
)


def _entries(units: DataFrame) -> DataFrame:
    return units.select(F.col("fixture.id").alias("fixture_id"), F.explode("players").alias("b")).select(
        "fixture_id", F.col("b.team.id").alias("team_id"), F.col("b.team.name").alias("team_name"), F.explode("b.players").alias("e")
    )


def flatten_entity_unit(units: DataFrame) -> DataFrame:
    """Wide row per player of a unit from the first statistics element; players without
    exposure or id are dropped."""
    first = _entries(units).withColumn("s", F.try_element_at("e.statistics", F.lit(1)))
    rows = first.select(
        "fixture_id",
        "team_id",
        "team_name",
        F.col("e.player.id").alias("player_id"),
        F.col("e.player.name").alias("player_name"),
        to_number0("s.games.minutes").alias("minutes"),
        to_number0("s.games.rating").alias("provider_rating"),
        *[to_number0(f"s.{path}").alias(name) for name, path in COUNTER_PATHS],
        accurate_count("s.passes.total", "s.passes.accuracy").alias("passes_accurate"),
    )
    return rows.where((F.col("minutes") > 0) & F.col("player_id").isNotNull())


def flatten_entity_unit_full(units: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Every statistics element with its raw fields, for the target players only when
    given (left-semi join)."""
    rows = (
        _entries(units)
        .where(F.col("e.player.id").isNotNull())
        .select("fixture_id", "team_id", "team_name", F.col("e.player").alias("p"), F.explode("e.statistics").alias("s"))
        .select(
            "fixture_id",
            "team_id",
            "team_name",
            F.col("p.id").alias("player_id"),
            F.col("p.name").alias("player_name"),
            F.col("s.games.minutes").alias("minutes"),
            *[F.col(f"s.{path}").alias(name) for name, path in (*COUNTER_PATHS, *RAW_PATHS)],
        )
    )
    return rows if targets is None else rows.join(targets.select("player_id"), "player_id", "left_semi")


def flatten_lineups(units: DataFrame) -> DataFrame:
    """Starters and substitutes as rows tagged with the list they came from."""
    tag = lambda source: F.transform(
        F.coalesce(F.col(f"l.{source}"), F.array().cast("array<struct<player:struct<id:bigint,name:string,number:int,pos:string,grid:string>>>")),
        lambda x: F.struct(F.lit(source).alias("source"), x["player"].alias("player")),
    )
    return (
        units.select(F.col("fixture.id").alias("fixture_id"), F.explode("lineups").alias("l"))
        .select(
            "fixture_id", F.col("l.team.id").alias("team_id"), F.col("l.formation").alias("formation"),
            F.explode(F.concat(tag("startXI"), tag("substitutes"))).alias("x"),
        )
        .select(
            "fixture_id", "team_id", "formation", F.col("x.source").alias("lineup_source"),
            F.col("x.player.id").alias("player_id"), F.col("x.player.name").alias("player_name"),
            F.col("x.player.pos").alias("lineup_position"), F.col("x.player.grid").alias("grid"),
        )
        .where(F.col("player_id").isNotNull())
    )


def flatten_events(units: DataFrame) -> DataFrame:
    """Event rows; the minute is elapsed plus added time, null without elapsed."""
    return units.select(F.col("fixture.id").alias("fixture_id"), F.explode("events").alias("e")).select(
        "fixture_id",
        F.col("e.team.id").alias("team_id"),
        F.col("e.type").alias("event_type"),
        F.col("e.detail").alias("detail"),
        event_minute("e.time.elapsed", "e.time.extra").alias("elapsed"),
        F.col("e.player.id").alias("player_id"),
        F.col("e.assist.id").alias("assist_id"),
        F.col("e.comments").alias("comments"),
    )


def target_events(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Substitutions and cards touching a target as player or assist. The OR becomes two
    marked left joins on unique ids, so each side is an equi-join."""
    rows = events.where(F.lower("event_type").isin("subst", "card"))
    ids = targets.select("player_id").distinct()
    as_player = ids.withColumn("__p", F.lit(True))
    as_assist = ids.select(F.col("player_id").alias("assist_id"), F.lit(True).alias("__a"))
    hit = rows.join(as_player, "player_id", "left").join(as_assist, "assist_id", "left")
    return hit.where(F.col("__p") | F.col("__a")).select(*events.columns)


def unit_metadata(units: DataFrame) -> DataFrame:
    """Status, which blocks are present, event count, distinct starters per side."""

    def starters(side: str) -> Column:
        blocks = F.filter("lineups", lambda b: b["team"]["id"] == F.col(f"teams.{side}.id"))
        ids = F.flatten(F.transform(blocks, lambda b: F.transform(b["startXI"], lambda x: x["player"]["id"])))
        present = F.array_distinct(F.filter(ids, lambda i: i.isNotNull()))
        return F.coalesce(F.size(present), F.lit(0))

    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return units.select(
        F.col("fixture.id").alias("fixture_id"),
        F.col("fixture.status.short").alias("status_short"),
        F.col("fixture.status.elapsed").alias("status_elapsed"),
        F.col("lineups").isNotNull().alias("lineups_present"),
        F.col("events").isNotNull().alias("events_present"),
        count("lineups").alias("lineup_team_blocks"),
        count("events").alias("event_count"),
        F.col("teams.home.id").alias("home_team_id"),
        F.col("teams.away.id").alias("away_team_id"),
        starters("home").alias("home_startxi_count"),
        starters("away").alias("away_startxi_count"),
    )


def unit_context(units: DataFrame) -> DataFrame:
    return units.where(F.col("fixture.id").isNotNull()).select(
        F.col("fixture.id").alias("fixture_id"),
        F.col("fixture.date").alias("api_date"),
        F.col("fixture.timestamp").alias("api_timestamp"),
        F.col("fixture.timezone").alias("api_timezone"),
        F.col("fixture.referee").alias("referee"),
        F.col("fixture.venue.id").alias("venue_id"),
        F.col("fixture.venue.name").alias("venue_name"),
        F.col("fixture.venue.city").alias("venue_city"),
        F.col("league.id").alias("league_id"),
        F.col("league.name").alias("league_name"),
        F.col("league.country").alias("league_country"),
        F.col("teams.home.name").alias("home_team"),
        F.col("teams.away.name").alias("away_team"),
    )


def flatten_spatial_events(events: DataFrame, frames: DataFrame, keys: Sequence[str] = ("match_id",)) -> DataFrame:
    """Start and end coordinates, outcome, expected goals, and how many players the
    matched frame shows."""
    f = frames.select(*keys, F.col("event_uuid").alias("id"), "freeze_frame")
    rows = events.join(f, [*keys, "id"], "left")
    end = F.when(F.col("type") == "Pass", F.col("pass.end_location")).when(F.col("type") == "Carry", F.col("carry.end_location"))
    at = lambda a, i: F.try_element_at(a, F.lit(i))
    seen = F.coalesce(F.col("freeze_frame"), F.array().cast("array<struct<teammate:boolean>>"))
    mates = F.size(F.filter(seen, lambda x: F.coalesce(x["teammate"], F.lit(False))))
    return rows.select(
        *keys,
        F.col("id").alias("event_id"),
        "team",
        "type",
        F.coalesce("under_pressure", F.lit(False)).alias("under_pressure"),
        at(F.col("location"), 1).alias("x"),
        at(F.col("location"), 2).alias("y"),
        at(end, 1).alias("end_x"),
        at(end, 2).alias("end_y"),
        F.col("pass.outcome").alias("outcome"),
        F.col("shot.xg").alias("xg"),
        F.size(seen).alias("visible"),
        mates.alias("visible_teammates"),
        (F.size(seen) - mates).alias("visible_opponents"),
    )


def _normalised_events(events: str) -> Column:
    def one(e: Column) -> Column:
        kind, detail, note = (F.coalesce(normalise_key(e[x]), F.lit("")) for x in ("type", "detail", "comments"))
        minute = event_minute(e["time"]["elapsed"], e["time"]["extra"])
        return F.struct(
            kind.alias("kind"), detail.alias("detail"), note.alias("note"),
            (minute.isNull() | (minute <= 130)).alias("counted"),
        )

    return F.filter(F.transform(events, one), lambda e: e["counted"])


def _event_test(e: Column, name: str) -> Column:
    kind, detail, note = e["kind"], e["detail"], e["note"]
    sub = kind.isin("subst", "substitution")
    hurt = note.contains("injury") | note.contains("injured") | note.contains("medical")
    return {
        "event_yellow_cards": (kind == "card") & detail.contains("yellow") & ~detail.contains("second"),
        "event_red_cards": (kind == "card") & (detail.contains("red") | detail.contains("second yellow")),
        "substitutions": sub,
        "penalty_events": detail.contains("penalty") & ~note.contains("shootout"),
        "var_reviews": (kind == "var") | detail.contains("var"),
        "observable_injuries": sub & hurt,
    }[name]


# Counters of an event list.
EVENT_CLASSES = (
    "event_yellow_cards", "event_red_cards", "substitutions", "penalty_events", "var_reviews", "observable_injuries",
)


def event_class_counts(units: DataFrame, events: str = "events") -> DataFrame:
    """Counts per class over the event array of a row, without exploding it. The texts
    are normalised once, in a column of their own."""

    def count(name: str) -> Column:
        return F.coalesce(F.size(F.filter("__ev", lambda e: _event_test(e, name))), F.lit(0)).alias(name)

    return units.withColumn("__ev", _normalised_events(events)).select(
        *units.columns, *[count(name) for name in EVENT_CLASSES]
    )


#: What :func:`unit_outcome_row` reads of a payload.
OUTCOME_BLOCKS = ("fixture", "league", "teams", "goals", "score", "events", "statistics")


def unit_outcome_row(units: DataFrame) -> DataFrame:
    """Period goals, extra-time and shootout flags, two-side statistics, event counts."""
    def side_map(side: str) -> Column:
        block = F.try_element_at(F.filter("statistics", lambda b: b["team"]["id"] == F.col(f"teams.{side}.id")), F.lit(1))
        return stats_entries(block["statistics"])

    mapped = event_class_counts(units).withColumn("__h", side_map("home")).withColumn("__a", side_map("away"))
    both = lambda *names: null_aware_sum(pick_entry("__h", *names), pick_entry("__a", *names))
    period = lambda p: null_aware_sum(f"score.{p}.home", f"score.{p}.away")
    status = F.upper(normalise_key("fixture.status.short"))
    return mapped.select(
        F.col("fixture.id").alias("fixture_id"),
        F.col("fixture.date").alias("kickoff"),
        F.col("league.round").alias("round"),
        status.alias("status_short"),
        null_aware_sum("goals.home", "goals.away").alias("total_goals_all_periods"),
        period("halftime").alias("halftime_goals"),
        period("fulltime").alias("fulltime_goals"),
        status.isin("AET", "PEN").alias("extra_time_played"),
        (status == "PEN").alias("shootout_played"),
        both("total shots").alias("shots"),
        both("shots on goal", "shots on target").alias("shots_on_target"),
        both("fouls").alias("fouls"),
        both("corner kicks", "corners").alias("corners"),
        *EVENT_CLASSES,
    )
