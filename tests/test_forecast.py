"""Forecasts against brute force, and the streams."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.catalog import forecast_q
from cohortlens.operators import ordered
from cohortlens.plans import forecast as M
from cohortlens.session import cut_lineage, scratch_path
from cohortlens.streaming import streams as T


@pytest.fixture(scope="module")
def matches(spark):
    rows = []
    for i in range(60):
        h, a = i % 5, (i * 3 + 1) % 5
        a = (a + 1) % 5 if a == h else a
        rows.append(("x" if i % 3 else "y", i, f"2024-01-{1 + i // 3:02d} 12:00:00", h, a, (i * 7) % 4, (i * 5) % 3))
    df = spark.createDataFrame(rows, "comp string, unit long, ts string, home long, away long, home_goals int, away_goals int")
    return df.withColumn("ts", F.to_timestamp("ts")).cache()


def brute_elo(rows):
    out, state = {}, {}
    for r in sorted(rows, key=lambda r: (r.comp, r.ts, r.unit)):
        book = state.setdefault(r.comp, {})
        h, a = book.get(r.home, 1500.0), book.get(r.away, 1500.0)
        out[r.unit] = (h, a)
        e = 1 / (1 + 10 ** ((a - h) / 400))
        s = 1 if r.home_goals > r.away_goals else 0.5 if r.home_goals == r.away_goals else 0
        d = 24 * (math.log(abs(r.home_goals - r.away_goals) + 1) + 1) * (s - e)
        book[r.home], book[r.away] = h + d, a - d
    return out


def test_elo_matches_a_plain_loop(spark, matches):
    want = brute_elo(matches.collect())
    got = {r.unit: (r.elo_home, r.elo_away) for r in M.elo_ratings(matches).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_parts_of_a_competition(spark):
    """Two halves that never meet, a chain of sides, a side that plays itself, and a
    competition without a name."""
    rows = [("c", i, i // 3, i % 4, (i + 1) % 4, i % 3, i % 2) for i in range(30)] + [("c", 100 + i, i, 10 + i, 11 + i, 2, i % 4) for i in range(25)]
    rows += [("c", 200, 1, 50, 50, 1, 0), (None, 300, 1, 1, 2, 3, 0), (None, 301, 2, 2, 1, 1, 1), ("d", 400, 1, 1, 10, 0, 0)]
    df = spark.createDataFrame(rows, "comp string, unit long, ts long, home long, away long, home_goals int, away_goals int").repartition(5)
    parts = {(r.comp, r.side): r.part for r in M.elo_parts(df).collect()}
    assert {parts["c", s] for s in range(4)} == {0} and {parts["c", s] for s in range(10, 36)} == {10} and parts["c", 50] == 50
    assert parts[None, 2] == 1 and parts["d", 10] == 1 and len(parts) == 35
    want = {}
    for comp in ("c", None, "d"):
        book = {}
        for _, u, _, h, a, gh, ga in sorted((r for r in rows if r[0] == comp), key=lambda r: (r[2], r[1])):
            rh, ra = book.get(h, 1500.0), book.get(a, 1500.0)
            want[u] = (rh, ra)
            d = 24 * (math.log(abs(gh - ga) + 1) + 1) * ((gh > ga) + 0.5 * (gh == ga) - 1 / (1 + 10 ** ((ra - rh) / 400)))
            book[h] = book.get(h, 1500.0) + d
            book[a] = book.get(a, 1500.0) - d
    got = {r.unit: (r.elo_home, r.elo_away) for r in M.elo_ratings(df).collect()}
    assert got.keys() == want.keys() and all(got[u] == pytest.approx(want[u], abs=1e-9) for u in want)


def test_streamed_elo_equals_the_batch(spark, matches):
    path = scratch_path(spark, "elo")
    ahead = matches.limit(1).select(F.lit("~").alias("comp"), F.lit(-1).cast("long").alias("unit"), F.expr("ts + interval 1 year").alias("ts"), *matches.columns[3:])
    # Out of order by up to eight days.
    for i, part in enumerate(("unit >= 12 and unit < 24", "unit < 12", "unit >= 36 and unit < 48", "unit >= 24 and unit < 36", "unit >= 48")):
        matches.where(part).coalesce(1).write.parquet(f"{path}/p{i}")
    ahead.coalesce(1).write.parquet(f"{path}/p9")
    stream = T.stream_batches(T.keyed_state(spark), f"{path}/p*", matches.schema, max_files=1)
    out = scratch_path(spark, "elo-out")
    T.drain(T.stream_elo(stream, "10 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "ck")))
    want = brute_elo(matches.collect())
    got = {r.unit: (r.elo_home, r.elo_away) for r in spark.read.parquet(out).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_waiting_matches_are_kept_in_runs(spark, matches, monkeypatch):
    """Runs of three that overlap and that the watermark cuts, and a match that comes
    twice before its time: its last form counts. The state has fewer rows than matches wait."""
    monkeypatch.setattr(T, "RUN", 3)
    monkeypatch.setattr(T, "GATHER", 7)
    path = scratch_path(spark, "elo")
    first = matches.where("unit = 5").withColumn("home_goals", F.col("home_goals") + 3)
    first.unionByName(matches.where("unit >= 12 and unit < 36")).coalesce(1).orderBy(F.col("unit") % 7, "unit").write.parquet(f"{path}/p0")
    for i, part in enumerate(("unit < 12", "unit >= 36", "unit < 0")):
        matches.where(part).coalesce(1).orderBy(F.col("unit") % 5, "unit").write.parquet(f"{path}/p{i + 1}")
    ahead = matches.limit(1).select(F.lit("~").alias("comp"), F.lit(-1).cast("long").alias("unit"), F.expr("ts + interval 1 year").alias("ts"), *matches.columns[3:])
    ahead.coalesce(1).write.parquet(f"{path}/p9")
    stream = T.stream_batches(T.keyed_state(spark), f"{path}/p*", matches.schema, max_files=1)
    out = scratch_path(spark, "elo-out")
    T.drain(T.stream_elo(stream, "12 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "ck")))
    want = brute_elo(matches.collect())
    rows = spark.read.parquet(out).collect()
    got = {r.unit: (r.elo_home, r.elo_away) for r in rows}
    assert len(rows) == len(want) and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_state_does_not_grow_with_each_waiting_match(spark):
    path = scratch_path(spark, "elo")
    rows = spark.range(5000).selectExpr("'c' comp", "id unit", "timestamp_seconds(id) ts", "id % 7 home", "id % 7 + 1 away", "cast(id % 3 as int) home_goals", "cast(id % 2 as int) away_goals")
    rows.coalesce(1).write.parquet(path)
    stream = T.stream_batches(T.keyed_state(spark), path, rows.schema)
    query = T.drain(T.stream_elo(stream, "2 days").writeStream.format("parquet").option("path", scratch_path(spark, "out")).option("checkpointLocation", scratch_path(spark, "ck")))
    assert 0 < max(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators) < 100


def test_last_form_counts_feature_rows_only(spark, matches):
    feats = matches.where("unit % 2 = 0").select("unit", F.col("home").alias("side"), (F.col("unit") % 9).cast("double").alias("rating"), F.lit(1.0).alias("shots"), F.lit(0.5).alias("pass_accuracy"))
    rows = sorted(matches.collect(), key=lambda r: (r.comp, r.ts, r.unit))
    seen, want = {}, {}
    for r in rows:
        mean = lambda s: (sum(seen.get((r.comp, s), [])[-5:]) / len(seen[(r.comp, s)][-5:])) if seen.get((r.comp, s)) else 6.5  # noqa: E731, B023
        want[r.unit] = (mean(r.home), mean(r.away))
        if r.unit % 2 == 0:
            seen.setdefault((r.comp, r.home), []).append(float(r.unit % 9))
    got = {r.unit: (r.home_rating, r.away_rating) for r in M.last_form(matches, feats).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_matrix_and_probabilities_sum_to_one(spark):
    one = spark.createDataFrame([(1, 1.4, 1.1, -0.05)], "u long, lh double, la double, rho double")
    cells = M.poisson_matrix(one, ["u"], "lh", "la", "rho")
    assert cells.count() == 121
    assert cells.agg(F.sum("p")).first()[0] == pytest.approx(1.0)
    p = M.outcome_probs(one, "lh", "la", "rho").first()
    home = cells.where("i > j").agg(F.sum("p")).first()[0]
    assert p.p_home == pytest.approx(home) and p.p_home + p.p_draw + p.p_away == pytest.approx(1.0)
    assert min(p.p_home, p.p_draw, p.p_away) > 0


def test_proper_score_ranges(spark):
    r = M.proper_scores(spark.createDataFrame([(0.5, 0.25, 0.25, "H")], "p_home double, p_draw double, p_away double, actual string")).first()
    assert 0 <= r.brier <= 2 and r.log_loss > 0 and 0 <= r.rps <= 1 and r.accuracy


def test_backtest_is_the_same_on_any_partitioning(spark, matches):
    run = lambda m: sorted((r.unit, r.model, round(r.log_loss, 7)) for r in M.rolling_backtest(m, warm_up=5).collect())
    plain = run(matches)
    assert plain and run(matches.repartition(7)) == plain


def brute_rho(rows, minimum):
    """(comp, unit) -> the grid value with the largest log-likelihood over earlier rows."""
    out, total, seen = {}, {}, {}
    for comp, _, unit, gh, ga, lh, la in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1], r[2])):
        run = total.setdefault(comp, [0.0] * 81)
        best = [round(x, 9) for x in run]
        out[comp, unit] = round(best.index(max(best)) * 0.005 - 0.2, 6) if seen.get(comp, 0) >= minimum else 0.0
        seen[comp] = seen.get(comp, 0) + 1
        h, a = ([math.exp(k * math.log(r) - r) / math.factorial(k) for k in range(11)] for r in (lh, la))
        for k in range(81):
            rho = k * 0.005 - 0.2
            tau = {(0, 0): 1 - lh * la * rho, (0, 1): 1 + lh * rho, (1, 0): 1 + la * rho, (1, 1): 1 - rho}
            tau = {c: max(0.05, x) for c, x in tau.items()}
            mass = sum(h[i] * a[j] * tau.get((i, j), 1.0) for i in range(11) for j in range(11))
            run[k] += math.log(max(1e-12, h[min(gh, 10)] * a[min(ga, 10)] * tau.get((gh, ga), 1.0) / mass))
    return out


def test_grid_values_are_made_where_they_are_added(spark, monkeypatch):
    """Against a plain loop, in many chunks, with a competition without a name and one in a
    single row; what is written holds a match's few numbers, not the whole grid."""
    monkeypatch.setattr(ordered, "SAMPLE_BITS", 0)
    monkeypatch.setattr(ordered, "PER_CHUNK", 16)
    written, draw = [], random.Random(5)
    monkeypatch.setattr(M, "cut_lineage", lambda df: written.append(df) or cut_lineage(df))
    rows = [(None if i % 3 == 0 else "c", i // 2, i, draw.choice((0, 0, 1, 1, 2, 3, 12)), draw.choice((0, 1, 1, 2)), 0.4 + i % 7 / 6, 0.3 + i % 5 / 4) for i in range(240)] + [("d", 1, 999, 0, 0, 1.2, 0.9)]
    df = spark.createDataFrame(rows, "comp string, ts long, unit long, home_goals int, away_goals int, lambda_home double, lambda_away double").repartition(5)
    got = M.rho_grid_fit(df.where("comp is not null"), 4)
    want = brute_rho([r for r in rows if r[0] is not None], 4)
    assert {(r.comp, r.unit): r.rho for r in got.collect()} == want and len(set(want.values())) > 3
    M.rho_grid_fit(df, 4).collect()
    assert written and not any(kind.startswith("array") for x in written for _, kind in x.dtypes)


def test_late_rows_change_the_ledger(spark):
    path = scratch_path(spark, "late")
    for i, rows in enumerate(([(1, "2024-01-05 00:00:00")], [(1, "2024-01-01 00:00:00"), (1, "2024-01-06 00:00:00")])):
        spark.createDataFrame(rows, "k long, ts string").select("k", F.to_timestamp("ts").alias("ts"), F.lit(1.0).alias("v")).coalesce(1).write.parquet(f"{path}/in/b{i}")
    schema = spark.read.parquet(f"{path}/in/*").schema
    stream = T.stream_batches(spark, f"{path}/in/*", schema, max_files=1)
    T.drain(T.late_requery(stream, "ts", ["k"], ["v"], 3600, f"{path}/out", f"{path}/ck"))
    row = T.requery_view(spark, f"{path}/out", ["k"], ["v"]).first()
    assert (row.n, row.late_n, row.v) == (3, 1, 3.0)
