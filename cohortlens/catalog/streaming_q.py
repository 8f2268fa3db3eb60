"""Streaming queries: the events table is laid out by day in the shared folder and
replayed from there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from ..sources.ledger import Ledger
from ..streaming import streams as T
from .base import query
from .forecast_q import ELO_SQL, matches


def replay(t, max_files=None, flush=False):
    """Events as a file stream, one folder per day. With ``flush`` an event without a user
    follows in a later file, far enough ahead to close every window."""
    path = scratch_path(t.spark, "replay")
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("v", F.floor(F.col("value")))
    rows = rows.withColumn("day", F.to_date("ts"))
    rows.repartition("day").write.partitionBy("day").parquet(path)
    schema = rows.drop("day").schema
    if flush:
        last = t.events.agg(F.max(F.col("ts").cast("timestamp")).alias("ts"))
        blank = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "ts" else (F.col("ts") + F.expr("interval 30 days")).alias("ts") for f in schema]
        last.select(*blank).withColumn("day", F.lit("9999-01-01")).write.mode("append").partitionBy("day").parquet(path)
    return T.stream_batches(t.spark, f"{path}/day=*", schema, max_files=max_files)


def to_table(t, stream, mode="append"):
    """Drain a stream into a table of the shared folder and read it back."""
    path = scratch_path(t.spark, "sink")
    T.drain(stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", scratch_path(t.spark, "ckpt")))
    return t.spark.read.schema(stream.schema).parquet(path)


@query("T1_stream_batches", "SELECT event_type, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS v FROM events GROUP BY event_type")
def _(t):
    out = to_table(t, replay(t, max_files=8).select("event_type", "v"))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))


@query(
    "T2_stream_upsert",
    """SELECT user_id, event_type, event_id, n AS attempts FROM (SELECT e.*, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events e WHERE value>=10) JOIN (
  SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) USING (user_id, event_type) WHERE rn=1""",
)
def _(t):
    path = scratch_path(t.spark, "upsert")
    keys, order = ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]
    stream = replay(t, max_files=8).select("user_id", "event_type", "event_id", "ts", "value")
    ledger = Ledger(path, tuple(keys), tuple(order), 16)
    T.drain(T.stream_upsert(stream, ledger, F.col("value") < 10, scratch_path(t.spark, "ckpt")))
    return ledger.rows(t.spark).select("user_id", "event_type", "event_id", "attempts")


def matches_by_year(t, path):
    """Matches as files of a stream, a year each and every second year before the one it
    follows; at the end one match far ahead, of a competition of its own. The years."""
    m = matches(t).select(
        F.col("comp").cast("string").alias("comp"), "unit", F.col("ts").cast("timestamp").alias("ts"), F.col("home").cast("long").alias("home"), F.col("away").cast("long").alias("away"), "home_goals", "away_goals"
    )
    m = cut_lineage(m)
    by_year = m.withColumn("y", F.year("ts"))
    years = sorted(r.y for r in by_year.select("y").distinct().collect())
    for turn, i in enumerate(i ^ 1 if i ^ 1 < len(years) else i for i in range(len(years))):
        by_year.where(F.col("y") == years[i]).drop("y").repartition(2).write.parquet(f"{path}/turn={turn:03d}")
    last = m.agg(F.max("ts").alias("ts")).select(F.lit("~").alias("comp"), F.lit(-1).cast("long").alias("unit"), F.expr("ts + interval 10 years").alias("ts"), *[F.lit(i).cast(m.schema[n].dataType).alias(n) for i, n in enumerate(m.columns[3:])])
    last.coalesce(1).write.parquet(f"{path}/turn=999")
    return m.schema


@query("T3_stream_elo", f"WITH RECURSIVE {ELO_SQL} SELECT CAST(comp AS VARCHAR) AS comp, unit, round(eh,6) AS elo_home, round(ea,6) AS elo_away FROM er WHERE k>0", ("mt",))
def _(t):
    path = scratch_path(t.spark, "matches")
    schema = matches_by_year(t, path)
    stream = T.stream_batches(T.keyed_state(t.spark), f"{path}/turn=*", schema, max_files=2)
    out = to_table(t, T.stream_elo(stream, "731 days")).where("comp <> '~'")
    return out.select("comp", "unit", F.round("elo_home", 6).alias("elo_home"), F.round("elo_away", 6).alias("elo_away"))


@query(
    "T4_stream_entity_totals",
    """SELECT strftime(s,'%Y-%m-%d') AS day, user_id, n, v FROM (SELECT date_trunc('day', ts) AS s, user_id, count(*) AS n, CAST(sum(floor(value)) AS DOUBLE) AS v FROM events GROUP BY ALL)""",
)
def _(t):
    totals = T.stream_entity_totals(replay(t, flush=True).withColumn("v", F.col("v").cast("double")), "ts", "user_id", ["v"], "1 hour", "1 day")
    rows = to_table(t, totals).where(F.col("user_id").isNotNull())
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "user_id", "n", "v")


@query(
    "T5_late_requery",
    """SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN event_id%10=0 AND ts < (SELECT max(ts) FROM events WHERE event_id%10<>0) - INTERVAL 1 HOUR THEN 1 ELSE 0 END) AS BIGINT) AS late_n,
  CAST(sum(CAST(floor(value) AS BIGINT)) AS DOUBLE) AS v FROM events GROUP BY user_id""",
)
def _(t):
    # Nine tenths of the events come first, the others after all of them.
    src, path = scratch_path(t.spark, "tenths"), scratch_path(t.spark, "requery")
    rows = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.floor("value").cast("double").alias("v"), (F.col("event_id") % 10 == 0).cast("int").alias("turn"))
    first, second = (rows.where(F.col("turn") == turn).drop("turn") for turn in (0, 1))
    first.write.parquet(f"{src}/turn=0")
    files = len(t.spark.read.parquet(f"{src}/turn=0").inputFiles())
    second.repartition(files).write.parquet(f"{src}/turn=1")
    stream = T.stream_batches(t.spark, f"{src}/turn=*", first.schema, max_files=files)
    T.drain(T.late_requery(stream, "ts", ["user_id"], ["v"], 3600, path, scratch_path(t.spark, "ckpt")))
    return T.requery_view(t.spark, path, ["user_id"], ["v"]).select("user_id", "n", "late_n", "v")
