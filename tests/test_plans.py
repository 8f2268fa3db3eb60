"""Small exact cases and invariants of the composite plans."""

import pytest
from pyspark.sql import functions as F

from cohortlens.catalog import roles_q, windows_q
from cohortlens.operators import aggregates as A
from cohortlens.operators import filters, flatten, joins
from cohortlens.operators.resample import bootstrap_ci
from cohortlens.operators.tables import literal_table
from cohortlens.plans import ranking, roles, selection
from cohortlens.presets import football
from cohortlens.sources import io


def lineup(spark, formation, places):
    rows = [(1, 1, i, pos, *map(int, grid.split(":")), formation) for i, (pos, grid) in enumerate(places, 1)]
    return spark.createDataFrame(rows, "unit long, side long, entity long, pos string, row int, col int, formation string")


def roles_of(df):
    return {r.entity: r.role for r in roles.infer_roles(df).collect()}


def test_four_three_three(spark):
    places = [("G", "1:1")] + [("D", f"2:{c}") for c in range(1, 5)] + [("M", f"3:{c}") for c in range(1, 4)] + [("F", f"4:{c}") for c in range(1, 4)]
    got = roles_of(lineup(spark, "4-3-3", places))
    assert got == {1: "GK", 2: "FB", 3: "CB", 4: "CB", 5: "FB", 6: "CM", 7: "CM", 8: "CM", 9: "W", 10: "ST", 11: "W"}


def test_three_four_three_has_wing_backs(spark):
    places = [("G", "1:1")] + [("D", f"2:{c}") for c in range(1, 4)] + [("M", f"3:{c}") for c in range(1, 5)] + [("F", f"4:{c}") for c in range(1, 4)]
    got = roles_of(lineup(spark, "3-4-3", places))
    assert (got[5], got[6], got[8]) == ("FB", "CM", "FB")


def test_primary_role_share(spark):
    ev = spark.createDataFrame([(1, "CB", 180.0), (1, "FB", 60.0), (2, "CM", 90.0), (2, "DM", 90.0)], "entity long, role string, minutes double")
    got = {r.entity: r for r in roles.primary_role(ev).collect()}
    assert (got[1].primary_role, got[1].role_share, got[1].ambiguous) == ("CB", 0.75, False)
    assert got[2].ambiguous


@pytest.mark.parametrize("x,mapping,side", [(0.25, "low_is_left", "L"), (0.75, "low_is_left", "R"), (0.25, "low_is_right", "R"), (0.25, None, "LOW")])
def test_side_of(spark, x, mapping, side):
    assert spark.range(1).select(roles.side_of(F.lit(x), mapping)).first()[0] == side


def test_expected_units_per_window(spark):
    units = spark.createDataFrame(
        [(10, 1, 2026, 7, 8, True, True, False), (11, 1, 2026, 9, 7, True, True, True), (12, 1, 2026, 7, 9, False, True, True)],
        "unit long, league int, season int, home_id long, away_id long, official boolean, in_current boolean, in_pre boolean",
    )
    assoc = spark.createDataFrame([(1, 1, 2026, 7)], "entity long, league int, season int, side long")
    got = joins.expected_units(units, assoc, {"current": "in_current", "pre": "in_pre"}).collect()
    assert sorted((r.window, r.unit) for r in got) == [("current", 10), ("current", 11), ("pre", 11)]


def test_entity_features_accuracy(spark):
    row = spark.createDataFrame([(1, 90.0, 40.0, 32.0, 7.0)], "entity long, minutes double, passes double, passes_accurate double, rating double")
    out = A.entity_features(row, ["entity"], ["passes", "passes_accurate"], ["passes"], {"pass_accuracy": ("passes_accurate", "passes", 100.0)}, rating="rating", rating_key="entity").first()
    assert (out.pass_accuracy, out.passes_p90, out.rating_mean) == (80.0, 40.0, 7.0)


def test_validated_join_rejects_repeated_keys(spark):
    left = spark.createDataFrame([(1,)], "k long")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(Exception, match="repeated key"):
        joins.validated_join(left, right, ["k"]).collect()


def test_best_candidate_prefers_the_country(spark):
    rows = spark.createDataFrame([(1, 0, "Spain", "Guadalajara", 90), (1, 1, "Mexico", "Guadalajara", 50)], "q long, i int, country string, name string, population long")
    score = [(F.col("country") == "Mexico").cast("int"), (F.col("name") == "Guadalajara").cast("int"), F.col("population")]
    assert joins.best_candidate(rows, ["q"], score, "i").first().country == "Mexico"


def test_require_columns_names_the_missing(spark):
    with pytest.raises(ValueError, match=r"\['b'\]"):
        io.require_columns(spark.range(1).withColumnRenamed("id", "a"), ["a", "b"], "units")


def test_snapshot_chain_shapes(spark):
    """Eight roles with five entities each: centroids of five, eleven filled slots."""
    base = spark.range(40).select(
        F.col("id").alias("entity"),
        F.element_at(F.array(*[F.lit(r) for r in football.ROLES]), (F.col("id") % 8 + 1).cast("int")).alias("cohort"),
        (200.0 + F.col("id") * 3).alias("minutes"),
    )
    names = sorted({m for _, m, _ in football.ROLE_METRICS})
    feats = base.select("*", *[(((F.col("entity") * (i + 3)) % 17) / 3.0).alias(n) for i, n in enumerate(names)])
    metrics = literal_table(spark, [("cohort", "string"), ("metric", "string"), ("direction", "int")], football.role_metric_rows())
    ranked = ranking.rank_cohort(feats, metrics)
    cent, summary = ranking.build_centroids(ranked, metrics, 20, seed=1, resamples=50)
    assert summary.count() == 8 and summary.agg(F.max("actual_n")).first()[0] == 5
    assert not summary.where("sample_complete").count()
    assert cent.where("mean < ci95_low - 5 or mean > ci95_high + 5").count() == 0
    from cohortlens.operators.windows import slot_fill_ordinal

    slots = literal_table(spark, [("slot", "string"), ("cohort", "string"), ("ordinal", "int")], football.SLOTS)
    xi = slot_fill_ordinal(ranked, slots, "cohort", [F.col("position_rank"), F.col("minutes"), F.col("entity")], 2)
    assert xi.count() == 11 and xi.where("entity is null").count() == 0


def test_rank_cohort_is_the_same_on_any_partitioning(spark, tables):
    metrics, rows = windows_q.metric_table(tables), windows_q.features(tables)
    run = lambda f: sorted((r.entity, round(r.rank_score, 6), r.position_rank) for r in ranking.rank_cohort(f, metrics).collect())
    assert run(rows) == run(rows.repartition(7))


def test_bootstrap_is_repeatable_and_brackets_the_mean(spark):
    rows = spark.range(20).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    one = bootstrap_ci(rows, ["k"], "v", 5, 200).first()
    assert one == bootstrap_ci(rows.repartition(3), ["k"], "v", 5, 200).first()
    assert one.ci95_low < 9.5 < one.ci95_high
    single = bootstrap_ci(rows.limit(1), ["k"], "v", 5, 20).first()
    assert single.ci95_low == single.ci95_high


def test_frontier_and_gate_invariants(spark, tables):
    from cohortlens.catalog import selection_q

    players, gates = selection.selection_sufficiency(selection_q.candidates(tables))
    assert players.where("covered and needed").count() == 0
    assert gates.where("passed and unresolved > 0").count() == 0
    per_role = players.groupBy("role").agg(F.max("rank").alias("m"), F.count(F.lit(1)).alias("n"), F.countDistinct("rank").alias("d"))
    assert per_role.where("m <> n or d <> n").count() == 0


def test_combinations_enumerate_the_product(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), ("c", 7), ("c", 8), ("c", 9)], "role string, entity long")
    got = joins.combinations(spark, rows, "role", "entity").groupBy("combination").agg(F.array_sort(F.collect_list(F.struct("role", "entity"))).alias("x"))
    combos = [tuple(y.entity for y in r.x) for r in got.orderBy("combination").collect()]
    assert combos == [(a, 5, c) for a in (1, 2) for c in (7, 8, 9)]


def test_lineup_flatten_tolerates_missing_blocks(spark):
    from cohortlens.sources.schema import UNIT_FIELDS

    empty = spark.range(1).select(*[F.lit(None).cast(kind).alias(name) for name, kind in UNIT_FIELDS.items()])
    assert flatten.flatten_lineups(empty).count() == 0
    meta = flatten.unit_metadata(empty).first()
    assert (meta.lineups_present, meta.event_count, meta.home_startxi_count) == (False, 0, 0)


def test_completed_until_lets_missing_times_through(spark):
    rows = spark.createDataFrame([("FT", None), ("NS", None)], "status string, ts timestamp")
    assert filters.completed_until(rows, football.COMPLETED_STATUSES, F.current_timestamp()).count() == 1


def test_identified_lineups_cover_every_place(tables):
    counts = roles_q.lineups(tables).groupBy("unit").count()
    assert counts.where("count <> 11").count() == 0


def test_current_roles_are_not_broadcast(spark):
    """An explode hides the size of the current roles from the optimizer."""
    evidence = spark.createDataFrame([(1, 1, "CB", 60.0), (1, 2, "ST", 30.0), (2, 1, "GK", 90.0)], "entity long, unit long, role string, minutes double")
    current = spark.range(3).select(F.explode(F.array("id")).alias("entity"), F.lit("LCB").alias("current_role"))
    out = roles.aggregate_template_roles(evidence, current, ("GK", "LCB", "ST"))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.entity: (r.formation_role, r.distribution) for r in out.collect()} == {1: ("LCB", "CB:60m/1 | ST:30m/1"), 2: ("GK", "GK:90m/1")}
