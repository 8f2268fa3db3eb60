"""Declared schemas of nested unit payloads. Declaring them avoids inference and lets
nested pruning read only the fields a plan needs."""

from __future__ import annotations

_SIDE = "struct<id: bigint, name: string>"
_GOALS = "struct<home: int, away: int>"
_LINEUP_PLAYER = "struct<player: struct<id: bigint, name: string, number: int, pos: string, grid: string>>"

STATISTIC = (
    "struct<games: struct<minutes: double, number: int, position: string, rating: string, captain: boolean, substitute: boolean>,"
    " offsides: int,"
    " shots: struct<total: int, on: int>,"
    " goals: struct<total: int, conceded: int, assists: int, saves: int>,"
    " passes: struct<total: int, key: int, accuracy: string>,"
    " tackles: struct<total: int, blocks: int, interceptions: int>,"
    " duels: struct<total: int, won: int>,"
    " dribbles: struct<attempts: int, success: int>,"
    " fouls: struct<drawn: int, committed: int>,"
    " cards: struct<yellow: int, red: int>,"
    " penalty: struct<won: int, commited: int, scored: int, missed: int, saved: int>>"
)
PLAYERS = f"array<struct<team: {_SIDE}, players: array<struct<player: {_SIDE}, statistics: array<{STATISTIC}>>>>>"
LINEUPS = (
    f"array<struct<team: {_SIDE}, formation: string, startXI: array<{_LINEUP_PLAYER}>, substitutes: array<{_LINEUP_PLAYER}>>>"
)
EVENTS = (
    f"array<struct<time: struct<elapsed: int, extra: int>, team: {_SIDE}, player: {_SIDE}, assist: {_SIDE},"
    " type: string, detail: string, comments: string>>"
)
STATISTICS = f"array<struct<team: {_SIDE}, statistics: array<struct<type: string, value: string>>>>"
UNIT_FIELDS = {
    "fixture": "struct<id: bigint, date: string, timestamp: bigint, timezone: string, referee: string,"
    " venue: struct<id: bigint, name: string, city: string>, status: struct<short: string, elapsed: int>>",
    "league": "struct<id: bigint, name: string, country: string, season: int, round: string>",
    "teams": f"struct<home: {_SIDE}, away: {_SIDE}>",
    "goals": _GOALS,
    "score": f"struct<halftime: {_GOALS}, fulltime: {_GOALS}, extratime: {_GOALS}, penalty: {_GOALS}>",
    "lineups": LINEUPS,
    "players": PLAYERS,
    "events": EVENTS,
    "statistics": STATISTICS,
}
UNIT = "struct<" + ", ".join(f"{k}: {v}" for k, v in UNIT_FIELDS.items()) + ">"
ENVELOPE = f"response array<{UNIT}>"
