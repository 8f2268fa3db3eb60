"""Draws that travel in blocks against the same draws joined row by row."""

from pyspark.sql import functions as F

from cohortlens.operators import resample


def test_drawn_totals_equal_draws_joined_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 64)
    rows = [(side, i, None if (i + side) % 7 == 0 else (i * side) % 5) for side, size in ((3, 500), (-4, 1), (9, 130)) for i in range(size)]
    games = spark.createDataFrame(rows, "side int, i long, goals int").repartition(3)
    sizes = games.groupBy("side").agg(F.count("*").alias("m"))
    drawn = games.join(sizes, "side").select("side", "m", "i", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("world"))
    drawn = drawn.select("side", "world", resample.draw(11, F.col("world") * 65537 + F.col("side"), F.col("i"), F.col("m")).alias("i"))
    want = drawn.join(games, ["side", "i"]).groupBy("world", "side").agg(F.count("*").alias("n"), F.sum("goals").cast("double").alias("goals"))
    got = resample.drawn_totals(games, "side", "i", ["goals"], 9, 11)
    assert got.schema["side"].dataType == games.schema["side"].dataType
    key = lambda df: sorted(map(tuple, df.select("world", "side", "n", F.coalesce("goals", F.lit(-1.0))).collect()))
    assert len(key(want)) == 27 and key(got) == key(want)


def test_worlds_travel_as_places_in_blocks(spark, monkeypatch):
    """Weights by kept row equal those of draws joined row by row, nulls included; equal
    rows of a block come as one, and no row stands for a single draw."""
    monkeypatch.setattr(resample, "BLOCK", 64)
    monkeypatch.setattr(resample, "WORLDS", 4)
    rows = [(i, None if i % 11 == 0 else i % 3, "ab"[i % 2]) for i in range(500)]
    games = spark.createDataFrame(rows, "unit long, goals int, venue string").repartition(3)
    drawn = games.select(F.explode(F.sequence(F.lit(1), F.lit(9))).alias("world"), F.col("unit").alias("i"))
    drawn = drawn.select("world", resample.draw(11, F.col("world"), F.col("i"), F.lit(500)).alias("unit")).join(games, "unit")
    every = drawn.unionByName(games.withColumn("world", F.lit(0)))
    got = resample.bootstrap_worlds(games, ["unit"], 10, 11, ["goals", "venue"])
    assert got.columns == ["world", "weight", "goals", "venue"]
    key = lambda df, *c: sorted(map(tuple, df.na.fill(-1).select("world", *c, "n").collect()))
    for c, out in ((("goals", "venue"), got), (("unit", "goals"), resample.bootstrap_worlds(games, ["unit"], 10, 11))):
        want = every.groupBy("world", *c).agg(F.count("*").alias("n"))
        assert key(out.groupBy("world", *c).agg(F.sum("weight").alias("n")), *c) == key(want, *c)
    assert got.where("world > 0").groupBy("world").count().agg(F.max("count")).first()[0] <= 8 * 8
    assert resample.bootstrap_worlds(games.limit(0), ["unit"], 10, 11).count() == 0
