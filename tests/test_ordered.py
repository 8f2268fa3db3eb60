"""Ordered operators against plain windows and loops: a hot key, null keys and values,
infinities, ties. Planning runs no job."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.operators import aggregates, joins, ordered, windows


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(600).select(
        "id",
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 5, None).otherwise(F.col("id") % 7).alias("k"),
        F.when(F.col("id") % 11 != 0, ((F.col("id") * 37) % 101).cast("double")).alias("v"),
        (F.xxhash64("id") % 1000).alias("t"),
    )
    return df.cache()


def groups(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r.k, []).append(r)
    return out


def quantile(values, p):
    h = (len(values) - 1) * p
    lo, hi = values[math.floor(h)], values[math.ceil(h)]
    return lo + (h - math.floor(h)) * (hi - lo)


@pytest.mark.parametrize("down", [False, True])
def test_prefix_sums(spark, rows, down):
    lead = F.col("t").desc() if down else F.col("t")
    for keys in (["k"], []):
        got = {r.id: (r.s, r.i, r.whole) for r in ordered.prefix(rows, keys, [lead, F.col("id")], sums={"s": F.coalesce("v", F.lit(0.0))}, index="i", totals={"whole": "s"}).collect()}
        for own in (groups(rows) if keys else {None: rows.collect()}).values():
            run, place, whole = 0.0, 0, sum(r.v or 0.0 for r in own)
            for r in sorted(own, key=lambda r: (-r.t if down else r.t, r.id)):
                assert got[r.id] == (pytest.approx(run), place, pytest.approx(whole))
                run, place = run + (r.v or 0.0), place + 1


@pytest.fixture
def tiny_chunks(monkeypatch):
    """Chunks of some eight rows, so that small tables have many."""
    monkeypatch.setattr(ordered, "SAMPLE_BITS", 1)
    monkeypatch.setattr(ordered, "PER_CHUNK", 4)


ORDERS = [
    [ordered.By("t"), ordered.By("id")], [ordered.By("t", True), ordered.By("id", True)], [ordered.By("t", True), "id"],
    [ordered.By("v", nulls_first=False), "t", "id"], [ordered.By("v", True, nulls_first=True), ordered.By("id", True)], [ordered.By("v", True), "id"], ["text", "id"], [ordered.By("text", True), "id"],
]


@pytest.mark.parametrize("order", ORDERS, ids=str)
def test_any_order_over_many_chunks(spark, rows, tiny_chunks, order):
    df = rows.withColumn("text", F.concat(F.lit("https://example.org/"), F.hex(F.xxhash64("t"))))
    for keys in (["k"], []):
        group = Window.partitionBy(*keys).orderBy(*ordered.columns_of(order))
        want = df.withColumn("i", F.row_number().over(group).cast("long"))
        assert sorted(map(str, ordered.row_index(df, keys, order, "i").collect())) == sorted(map(str, want.collect()))
        assert ordered.chunked(df, keys, order).select("__key", "__chunk").distinct().count() > 20
    sums = ordered.prefix(df, ["k"], order, sums={"s": "id"}, totals={"whole": "s"})
    w = Window.partitionBy("k").orderBy(*ordered.columns_of(order)).rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("s", F.coalesce(F.sum("id").over(w), F.lit(0))).withColumn("whole", F.sum("id").over(Window.partitionBy("k")))
    assert sorted(map(str, sums.collect())) == sorted(map(str, want.collect()))


def test_many_chunks_of_everything_else(spark, rows, tiny_chunks, monkeypatch):
    for check in (test_quantiles, test_ranks_keep_null_groups, test_trimmed_mean, test_no_row_is_lost, test_asof_nearest_matches_brute_force, test_planning_runs_no_job):
        check(spark, rows)
    test_last_k(spark, rows, True, 7, monkeypatch)


def test_a_capped_sample_still_cuts(spark, rows, tiny_chunks, monkeypatch):
    monkeypatch.setattr(ordered, "MAX_CHUNKS", 8)
    monkeypatch.setattr(ordered, "STRATA", 4)
    for order in ORDERS[:3]:
        want = rows.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*ordered.columns_of(order))).cast("long"))
        assert sorted(map(str, ordered.row_index(rows, [], order, "i").collect())) == sorted(map(str, want.collect()))
        assert 2 <= ordered.chunked(rows, [], order).select("__chunk").distinct().count() <= 8


def test_chunks_are_even_in_rows(spark):
    """Ten million rows: 99 % of the values in 1 % of the range; ordered by text; a third
    of the rows equal in the leading column."""
    n = 10_000_000
    x = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000.0
    df = spark.range(0, n, 1, 8).select(
        "id", F.when(F.col("id") % 100 == 0, x).otherwise(x / 100).alias("crowded"),
        F.concat(F.lit("https://www.example.org/"), F.sha1(F.col("id").cast("string"))).alias("text"), F.when(F.col("id") % 3 == 0, 7).otherwise((x * 1000).cast("int")).alias("tied"),
    )
    for order in (["crowded", "id"], [ordered.By("text", True)], ["tied", "id"]):
        sizes = [r["count"] for r in ordered.chunked(df, [], order).groupBy("__chunk").count().collect()]
        assert sum(sizes) == n and len(sizes) > 100
        assert max(sizes) <= 2 * n / len(sizes)


def test_order_with_nulls_and_infinities(spark):
    values = [None, float("-inf"), -1.5, 0.0, 3.0, float("inf"), float("nan"), None, 7.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    for lead in (F.col("v").asc(), F.col("v").desc(), F.col("v").asc_nulls_last(), F.col("v").desc_nulls_first()):
        w = Window.partitionBy(F.lit(0)).orderBy(lead, "id")
        want = df.withColumn("i", F.row_number().over(w).cast("long")).collect()
        assert sorted(map(str, ordered.row_index(df, [], [lead, F.col("id")], "i").collect())) == sorted(map(str, want))


@pytest.mark.parametrize("current", [False, True])
@pytest.mark.parametrize("block", [7, 65_536])
def test_last_k(spark, rows, current, block, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", block)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(*((-4, 0) if current else (-5, -1)))
    want = rows.withColumn("m", F.round(F.avg("v").over(w), 9))
    got = ordered.last_k(rows, ["k"], [F.col("t"), F.col("id")], 5, {"m": F.avg("v")}, current).withColumn("m", F.round("m", 9))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_quantiles(spark, rows):
    probs = {"a": 0.05, "b": 0.5, "c": 0.95}
    got = {r.k: r for r in ordered.quantiles(rows, ["k"], ["v", "t"], probs).collect()}
    assert got.keys() == groups(rows).keys()
    for k, own in groups(rows).items():
        for c in ("v", "t"):
            values = sorted(float(r[c]) for r in own if r[c] is not None)
            for n, p in probs.items():
                assert got[k][f"{c}_{n}"] == pytest.approx(quantile(values, p))
    one = ordered.quantiles(rows, [], ["v"], probs).first()
    assert one.v_b == pytest.approx(quantile(sorted(r.v for r in rows.collect() if r.v is not None), 0.5))


def test_ranks_keep_null_groups(spark, rows):
    w = Window.partitionBy("k").orderBy(F.col("v").desc_nulls_last())
    want = rows.withColumn("r", F.when(F.col("v").isNotNull(), F.rank().over(w)).cast("long"))
    assert sorted(map(str, ordered.competition_rank(rows, ["k"], "v", "r").collect())) == sorted(map(str, want.collect()))
    got = {r.id: r.r for r in ordered.pct_rank_avg(rows, ["k"], "v", "r").collect()}
    for own in groups(rows).values():
        values = [r.v for r in own if r.v is not None]
        for r in own:
            below, same = sum(x < r.v for x in values) if r.v is not None else 0, values.count(r.v)
            assert got[r.id] == (None if r.v is None else pytest.approx((below + (same + 1) / 2) / len(values)))


def test_trimmed_mean(spark, rows):
    for guard in "ab":
        got = {r.k: r for r in ordered.trimmed_mean(rows, ["k"], "v", 0.1, guard).collect()}
        for k, own in groups(rows).items():
            values = sorted(r.v for r in own if r.v is not None)
            cut = len(values) // 10
            kept = values[cut : len(values) - cut]
            assert (got[k].n, got[k].trimmed_mean) == (len(values), pytest.approx(sum(kept) / len(kept)))


def test_no_row_is_lost(spark, rows):
    z = windows.winsorised_z(rows, ["k"], "v", "z").collect()
    u = windows.robust_unit(rows, ["k"], {"u": "v"}).collect()
    mu = windows.shrink_to_cohort(rows.withColumn("m", F.lit(90.0)), ["k"], "v", "m", 180.0, "s").collect()
    assert len(z) == len(u) == len(mu) == 600
    for k, own in groups(rows).items():
        values = sorted(r.v or 0.0 for r in own)
        lo, hi = quantile(values, 0.05), quantile(values, 0.95)
        cut = [min(max(x, lo), hi) for x in values]
        mean = sum(cut) / len(cut)
        sd = math.sqrt(sum((x - mean) ** 2 for x in cut) / len(cut))
        for r in (r for r in z if r.k == k):
            assert r.z == pytest.approx((min(max(r.v or 0.0, lo), hi) - mean) / sd)
        known = [r.v for r in own if r.v is not None]
        for r in (r for r in mu if r.k == k and r.v is not None):
            base = sum(known) / len(known)
            assert r.s == pytest.approx(base + (r.v - base) / 3)


def test_ecdf_sequence_and_shares(spark, rows):
    got = {r.id: r.cum_share for r in ordered.ecdf(rows, ["k"], "v", [F.col("v"), F.col("id")]).collect()}
    for own in groups(rows).values():
        placed = sorted((r.v, r.id) for r in own if r.v is not None)
        assert [got[i] for _, i in placed] == [pytest.approx((n + 1) / len(placed)) for n in range(len(placed))]
    seq = windows.sequence_in_group(rows, ["k"], [F.col("t"), F.col("id")]).collect()
    sizes = {k: len(own) for k, own in groups(rows).items()}
    assert len(seq) == 600 and all(r.group_size == sizes[r.k] for r in seq)
    assert sum(r.is_latest for r in seq) == len(sizes)
    shares = aggregates.value_distribution(rows, ["k"], "t").collect() if "k" in rows.columns else []
    assert all(r.share is not None for r in shares)


def test_planning_runs_no_job(spark, rows):
    sc = spark.sparkContext
    sc.setJobGroup("plans", "plans")
    try:
        order = [F.col("t"), F.col("id")]
        ordered.row_index(rows, ["k"], order, "i")
        ordered.quantiles(rows, ["k"], ["v"], {"m": 0.5})
        ordered.last_k(rows, ["k"], order, 3, {"m": F.avg("v")})
        windows.winsorised_z(rows, ["k"], "v", "z")
        windows.robust_unit(rows, ["k"], {"u": "v"})
        assert not sc.statusTracker().getJobIdsForGroup("plans")
    finally:
        sc.setJobGroup("", "")


def test_asof_nearest_matches_brute_force(spark, rows):
    at = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    left = rows.where("id % 2 = 0 and k is not null").select("k", at("t").alias("lt"), F.col("id").alias("lid"))
    right = rows.where("id % 2 = 1").select("k", at("t").alias("rt"), F.col("id").alias("rid"), "v")
    build = lambda: joins.asof_nearest(left, right, ["k"], "lt", "rt", "lid", "rid", ["v"]).select("lid", "right_id")
    gap = F.abs(F.unix_micros(F.col("lt").cast("timestamp")) - F.unix_micros(F.col("rt").cast("timestamp")))
    w = Window.partitionBy("lid").orderBy(gap, "rt", "rid")
    want = left.join(right, "k").withColumn("r", F.row_number().over(w)).where("r = 1").select("lid", F.col("rid").alias("right_id"))
    assert sorted(build().where("right_id is not null").collect()) == sorted(want.collect())
