"""Filters and predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def completed_until(units: DataFrame, statuses: Sequence[str], cutoff: Column | None, ts: str = "ts") -> DataFrame:
    """Finished units up to the cutoff; a missing cutoff or time lets the row through."""
    out = units.where(F.col("status").isin(*statuses))
    return out if cutoff is None else out.where(F.col(ts).isNull() | (F.col(ts) <= cutoff))


def eligibility_flags(df: DataFrame, exposure: str, share: str, levels: Mapping[str, tuple[float, float]]) -> DataFrame:
    """One boolean per level: enough exposure and enough detailed share."""
    return df.select(
        "*",
        *[
            ((F.coalesce(exposure, F.lit(0.0)) >= m) & (F.coalesce(share, F.lit(0.0)) >= s)).alias(n)
            for n, (m, s) in levels.items()
        ],
    )


def unit_inventory(units: DataFrame, covered: DataFrame, tracked: DataFrame) -> DataFrame:
    """Finished units of covered (league, season) pairs, inside any window, with a
    tracked side at home or away; once per unit. A unit has two sides, so the semi-join
    on sides shuffles two short rows per unit and no pair of units ever meets."""
    base = units.where(F.col("status").isin("FT", "AET", "PEN") & (F.col("in_current") | F.col("in_pre"))).join(
        covered, ["league", "season"], "left_semi"
    )
    sides = base.select("unit", F.explode(F.array("home_id", "away_id")).alias("side"))
    keep = sides.join(tracked, "side", "left_semi").select("unit").distinct()
    return base.join(keep, "unit", "left_semi")


def appeared(exposure: Column, actions: Sequence[Column], rating: Column, starter: Column) -> Column:
    """Played at all: exposure, any action, a rating, or a starting place."""
    some = reduce(lambda a, b: a | b, [F.coalesce(a, F.lit(0.0)) != 0 for a in actions])
    return (F.coalesce(exposure, F.lit(0.0)) > 0) | some | rating.isNotNull() | F.coalesce(starter, F.lit(False))


def window_membership(rows: DataFrame, windows: Mapping[str, str], name: str = "window") -> DataFrame:
    """One row per window the unit falls in; ``windows`` maps label -> flag column.
    Windows overlap, so a row may appear under several labels."""
    hits = F.array_compact(F.array(*[F.when(F.col(flag), F.lit(label)) for label, flag in windows.items()]))
    return rows.withColumn(name, F.explode(hits))


def window_ranges(rows: DataFrame, ts: str, ranges: Mapping[str, tuple[str, str]], name: str = "window") -> DataFrame:
    """As :func:`window_membership` from closed date ranges, without any join."""
    day = F.to_date(F.col(ts))
    hits = [F.when(day.between(F.to_date(F.lit(a)), F.to_date(F.lit(b))), F.lit(n)) for n, (a, b) in ranges.items()]
    return rows.withColumn(name, F.explode(F.array_compact(F.array(*hits))))


def complete_pair_evidence(home_starters: Column, away_starters: Column, feed: Column, status: Column) -> Column:
    return (
        (F.coalesce(home_starters, F.lit(0)) >= 11)
        & (F.coalesce(away_starters, F.lit(0)) >= 11)
        & F.coalesce(feed, F.lit(False))
        & F.coalesce(status.isin("FT", "AET", "PEN"), F.lit(False))
    )


def split_unsupported(units: DataFrame, rates: DataFrame, rate: str) -> DataFrame:
    """Marks units whose (league, season) showed endpoint rate 0 in the pilot."""
    out = units.join(rates.select("league", "season", rate), ["league", "season"], "left")
    return out.withColumn("unsupported", F.coalesce(F.col(rate) == 0, F.lit(False)))


def entities_without_rows(roster: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return roster.join(rows, key, "left_anti")


def catalog_select(catalog: DataFrame, name: str, pattern: str, order: Sequence[Column], n: int) -> DataFrame:
    """The n newest entries whose name matches the pattern (a top-n report)."""
    return catalog.where(F.col(name).rlike(pattern)).orderBy(*order).limit(n)
