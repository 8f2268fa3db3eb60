"""Context around units: event benchmark and weather."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bucketise
from ..operators.aggregates import distribution_summary
from ..operators.flatten import unit_outcome_row
from ..operators.joins import interval_join
from ..operators.ordered import join_on
from ..operators.windows import latest_by_key
from ..session import cut_lineage

_INF = float("inf")
# Lower edges and names of the heat bands.
HEAT_EDGES = (-_INF, 24.0, 29.0, 35.0, _INF)
HEAT_BANDS = ("cool_or_mild", "warm", "hot", "very_hot")


def event_benchmark(units: DataFrame, order: Sequence[Column], metrics: Sequence[str], core: Sequence[str], minimum: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Latest outcome row per unit summarised per metric, and the coverage gate over the
    core metrics. The metrics of the latest rows are written once, for the summary reads
    them several times and the units only pass by."""
    rows = cut_lineage(latest_by_key(unit_outcome_row(units), ["fixture_id"], order).select("fixture_id", *metrics))
    summary = distribution_summary(rows, metrics)
    gate = summary.where(F.col("metric").isin(*core)).agg(
        F.min("coverage").alias("core_coverage"), F.coalesce(F.bool_and(F.col("coverage") >= minimum), F.lit(False)).alias("passed")
    )
    return summary, gate


def weather_record(units: DataFrame, hours: DataFrame, place: str = "place", hours_ahead: int = 4) -> DataFrame:
    """Per unit the hours from the kick-off hour to four hours later at its place, from
    the best available grade; means, maxima, sums, the most frequent code, heat band.

    ``units``: unit, place, kickoff. ``hours``: place, time, grade, temperature, rain,
    code. Units without any hour are kept with grade ``unavailable``."""
    # Hours first: one row for each place, hour and grade, whatever the readings; readings
    # on the full hour apart, for only they count in a window's last hour.
    at = F.date_trunc("hour", F.col("time").cast("timestamp"))
    full = at == F.col("time").cast("timestamp")
    coded = hours.groupBy(place, at.alias("__h"), full.alias("__full"), "grade", "code").agg(
        F.count(F.lit(1)).alias("n"), F.sum("temperature").alias("ts"), F.count("temperature").alias("tn"),
        F.max("temperature").alias("tx"), F.sum("rain").alias("rs"),
    )
    hourly = coded.groupBy(place, "__h", "__full", "grade").agg(
        F.sum("n").alias("n"), F.sum("ts").alias("ts"), F.sum("tn").alias("tn"), F.max("tx").alias("tx"), F.sum("rs").alias("rs"),
        F.collect_list(F.struct("code", "n")).alias("codes"),
    )
    start = F.date_trunc("hour", F.col("kickoff").cast("timestamp"))
    end = start + F.make_dt_interval(hours=F.lit(hours_ahead))
    spans = units.select("unit", place, end.alias("__end"), F.explode(F.sequence(start, end, F.expr("interval 1 hour"))).alias("__h"))
    hits = spans.join(hourly, [place, "__h"]).where((F.col("__h") < F.col("__end")) | F.col("__full"))
    # A unit has at most a few rows here: its hours by grade.
    own = Window.partitionBy("unit")
    chosen = hits.withColumn("__best", F.min("grade").over(own)).where(F.col("grade") == F.col("__best"))
    stats = chosen.groupBy("unit").agg(
        F.max("grade").alias("grade"),
        F.sum("n").alias("window_hours"),
        (F.sum("ts") / F.sum("tn")).alias("temperature_mean"),
        F.max("tx").alias("temperature_max"),
        F.sum("rs").alias("rain_sum"),
        F.flatten(F.collect_list("codes")).alias("__codes"),
    )
    kinds = F.array_distinct(F.transform("__codes", lambda x: x["code"]))
    total = lambda code: F.aggregate(F.filter("__codes", lambda x: x["code"].eqNullSafe(code)), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    ranked = F.array_min(F.transform(kinds, lambda k: F.struct((-total(k)).alias("m"), k.isNull().alias("z"), k.alias("code"))))
    out = join_on(units, stats.withColumn("code_mode", ranked["code"]).drop("__codes"), ["unit"], "left")
    return out.withColumn("grade", F.coalesce("grade", F.lit("unavailable"))).withColumn(
        "heat_band", bucketise("temperature_max", HEAT_EDGES, HEAT_BANDS, right=False)
    )


def pre_window(units: DataFrame, hours: DataFrame, place: str = "place", hours_before: int = 3) -> DataFrame:
    """Mean, sum and maximum over the hours before kick-off."""
    kick = F.col("kickoff").cast("timestamp")
    start = kick - F.make_dt_interval(hours=F.lit(hours_before))
    each = hours.groupBy(place, "time").agg(
        F.sum("temperature").alias("ts"), F.count("temperature").alias("tn"), F.max("temperature").alias("tx"), F.sum("rain").alias("rs")
    )
    hits = interval_join(units.select("unit", place, "kickoff"), each, [place], start, kick, "time")
    return hits.groupBy("unit").agg(
        (F.sum("ts") / F.sum("tn")).alias("pre_temperature_mean"), F.sum("rs").alias("pre_rain_sum"), F.max("tx").alias("pre_temperature_max")
    )
