"""Structured Streaming forms of what is otherwise done by re-running batches.

Tables a stream maintains are append-only logs: each micro-batch overwrites only the
partition named by its own batch id, so a repeated batch after a failure leaves the same
rows, and the current state is a batch view over the log."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from ..operators.aggregates import zsum
from ..plans.forecast import elo_folder
from ..sources.ledger import Ledger


def stream_batches(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """Each new file of a folder once."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def _write_part(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def drain(writer) -> StreamingQuery:
    """Run a stream over what is there now and stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


# --- latest row per key --------------------------------------------------------------


def stream_upsert(stream: DataFrame, ledger: Ledger, retryable: Column, checkpoint: str):
    """Writer that puts each micro-batch into the ledger; a batch that Spark repeats after
    a failure changes nothing. Retryable rows are counted but never replace a row."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        ledger.apply(batch, retryable, batch_id)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def within_attempts(view: DataFrame, limit: int) -> DataFrame:
    """Keys that may still be asked for again."""
    return view.where(F.col("attempts") < limit)


def drop_repeats(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Exact repeats within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


# --- Elo in event-time order ---------------------------------------------------------


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> SparkSession:
    """The session with the state store that map state and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


#: Matches that are put in order together when they come; matches of a stored run.
GATHER, RUN = 1 << 16, 1 << 13


def stream_elo(matches: DataFrame, delay: str) -> DataFrame:
    """Pre-match ratings as a stream. A competition keeps two maps: ratings by side, and
    the matches still inside the watermark, packed in runs of up to ``RUN`` in time order,
    so that the calls to the state store do not grow with each match. One timer stands at
    the first match; when the watermark passes it, all matches behind the watermark leave
    in time order and the timer moves on. Runs are opened as their first match comes up,
    and what is behind the next run leaves at once, so only runs that overlap are held.
    Files may come out of order by up to ``delay``; a match that comes later still is
    dropped, and one that comes again while the first still waits takes its place. The
    last matches leave when later rows (of any competition) move the watermark past them.
    ``matches``: comp string, unit long, ts timestamp, home long, away long, home_goals
    int, away_goals int. See `keyed_state`."""
    rate = elo_folder()
    gather, size, width = GATHER, RUN, 6

    def in_order(rows: np.ndarray, arrival: np.ndarray) -> np.ndarray:
        """Places by (at, unit); of equal ones the last to arrive."""
        order = np.lexsort((arrival, rows[:, 1], rows[:, 0]))
        at = rows[order, :2]
        return order[np.append((at[1:] != at[:-1]).any(axis=1), True)] if len(order) else order

    def blank() -> pd.DataFrame:
        return pd.DataFrame({"comp": [], "unit": [], "elo_home": [], "elo_away": []}).astype({"comp": str, "unit": "int64"})

    class Elo(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.ratings = handle.getMapState("ratings", "side long", "rating double")
            self.runs = handle.getMapState("runs", "at long, number long", "matches binary")
            self.next = handle.getValueState("next", "number long")
            self.first = handle.getValueState("first", "at long")

        def _wait(self, at: int) -> None:
            """One timer, at the first pending match (microseconds)."""
            now = self.first.get()[0] if self.first.exists() else None
            if now is None or at < now:
                if now is not None:
                    self.handle.deleteTimer(now // 1000)
                self.handle.registerTimer(at // 1000)
                self.first.update((at,))

        def _keep(self, held: list[np.ndarray]) -> None:
            """New runs; a later run has a larger number."""
            rows = np.concatenate(held)
            rows = rows[in_order(rows, np.arange(len(rows)))]
            number = self.next.get()[0] if self.next.exists() else 0
            for i in range(0, len(rows), size):
                self.runs.updateValue((int(rows[i, 0]), number), (rows[i : i + size].tobytes(),))
                number += 1
            self.next.update((number,))
            self._wait(int(rows[0, 0]))

        def handleInputRows(self, key, rows, timerValues):
            held = []
            for pdf in rows:
                at = pdf["ts"].astype("datetime64[us]").astype("int64")
                if len(pdf):
                    held.append(np.column_stack([at, *[pdf[x].astype("int64") for x in ("unit", "home", "away", "home_goals", "away_goals")]]))
                if sum(map(len, held)) >= gather:
                    self._keep(held)
                    held = []
            if held:
                self._keep(held)
            yield blank()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            mark = timerValues.getCurrentWatermarkInMs() * 1000
            runs = sorted((at, number) for at, number in self.runs.keys())
            due = [run for run in runs if run[0] <= mark]
            later = [at for at, _ in runs[len(due) : len(due) + 1]]
            book, rows, arrival = _Book(self.ratings), np.empty((0, width), np.int64), np.empty(0, np.int64)
            opened, number = [], []
            for i, run in enumerate(due):
                opened.append(np.frombuffer(self.runs.getValue(run)[0], np.int64).reshape(-1, width))
                number.append(np.full(len(opened[-1]), run[1]))
                self.runs.removeKey(run)
                last = i + 1 == len(due)
                if not last and sum(map(len, opened)) < gather:
                    continue
                rows, arrival = np.concatenate([rows, *opened]), np.concatenate([arrival, *number])
                opened, number = [], []
                # All with the time of the next run's first match must wait for that run.
                ready = rows[:, 0] <= mark if last else rows[:, 0] < due[i + 1][0]
                out = rows[ready]
                out = out[in_order(out, arrival[ready])]
                rows, arrival = rows[~ready], arrival[~ready]
                folded = rate(book, zip(*out[:, 2:].T.tolist()))
                yield pd.DataFrame({"comp": [key[0]] * len(out), "unit": out[:, 1], "elo_home": [x[0] for x in folded], "elo_away": [x[1] for x in folded]}) if len(out) else blank()
            for n in np.unique(arrival).tolist():
                rest = rows[arrival == n]
                later.append(int(rest[0, 0]))
                self.runs.updateValue((later[-1], n), (rest.tobytes(),))
            book.store()
            self.first.clear()
            if later:
                self._wait(min(later))
            if not due:
                yield blank()

        def close(self) -> None:
            pass

    class _Book(dict):
        """Ratings read from the map state when first asked for."""

        def __init__(self, state):
            super().__init__()
            self.state = state

        def get(self, side, start):
            if side not in self:
                self[side] = self.state.getValue((side,))[0] if self.state.containsKey((side,)) else start
            return self[side]

        def store(self) -> None:
            for side, rating in self.items():
                self.state.updateValue((side,), (rating,))

    return (
        matches.withWatermark("ts", delay)
        .groupBy("comp")
        .transformWithStateInPandas(Elo(), "comp string, unit long, elo_home double, elo_away double", "Append", "EventTime")
    )


# --- running totals ------------------------------------------------------------------


def stream_entity_totals(
    events: DataFrame, ts: str, entity: str, sums: Sequence[str], delay: str, length: str, slide: str | None = None, gap: str | None = None
) -> DataFrame:
    """Per entity and event-time window (tumbling, sliding, or session with ``gap``)."""
    frame = F.session_window(ts, gap) if gap else F.window(ts, length, slide) if slide else F.window(ts, length)
    return (
        events.withWatermark(ts, delay)
        .groupBy(frame.alias("w"), entity)
        .agg(F.count(F.lit(1)).alias("n"), *[zsum(x).alias(x) for x in sums])
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), entity, "n", *sums)
    )


def late_requery(stream: DataFrame, ts: str, keys: Sequence[str], sums: Sequence[str], delay_seconds: int, path: str, checkpoint: str):
    """Writer that keeps totals right when details arrive late: rows behind the largest
    time of earlier batches minus the delay go to a side log, all others to the main log;
    the ledger adds both. The marks of earlier batches are read from the log itself."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = None
        if batch_id > 0:
            seen = spark.read.option("basePath", f"{path}/marks").parquet(f"{path}/marks/*")
            mark = seen.where(F.col("batch") < batch_id).agg(F.max("mark")).first()[0]
        rows = batch.withColumn(
            "__late",
            F.lit(False) if mark is None else F.col(ts) < F.lit(mark) - F.make_dt_interval(secs=F.lit(delay_seconds)),
        )
        totals = rows.groupBy("__late", *keys).agg(F.count(F.lit(1)).alias("n"), *[zsum(x).alias(x) for x in sums])
        _write_part(totals.withColumnRenamed("__late", "late"), f"{path}/totals", batch_id)
        _write_part(batch.agg(F.max(ts).alias("mark")), f"{path}/marks", batch_id)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def requery_view(spark: SparkSession, path: str, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Ledger rows with the part that arrived late."""
    log = spark.read.option("basePath", f"{path}/totals").parquet(f"{path}/totals/*")
    return log.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("late"), F.col("n")).otherwise(0)).alias("late_n"),
        *[F.sum(x).alias(x) for x in sums],
    )
