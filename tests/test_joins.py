"""Interval join and alias match against plain loops."""

import random

from pyspark.sql import functions as F

from cohortlens.operators import joins as J


def test_interval_join_of_any_length(spark):
    random.seed(8)
    spans = [0, 1, 999_999, 60_000_000, 14_400_000_000, 86_400_000_000 * 40, 86_400_000_000 * 3650, -1]
    left = [(i, random.choice([1, 2, None]), random.randrange(-(10**15), 10**15), random.choice(spans)) for i in range(120)]
    right = [(i, random.choice([1, 2, None]), random.randrange(-(10**15), 10**15)) for i in range(300)]
    right += [(1000 + 2 * i + j, k, s + j * n) for i, (_, k, s, n) in enumerate(left) for j in (0, 1)]  # on both ends
    at = F.timestamp_micros
    lf = spark.createDataFrame(left, "lid long, k long, s long, n long").select("lid", "k", at("s").alias("t0"), at(F.col("s") + F.col("n")).alias("t1"))
    rf = spark.createDataFrame(right, "rid long, k long, t long").select("rid", "k", at("t").alias("ts"))
    got = J.interval_join(lf, rf, ["k"], F.col("t0"), F.col("t1"), "ts").select("lid", "rid").collect()
    want = [(l, r) for l, k, s, n in left for r, k2, t in right if k is not None and k == k2 and s <= t <= s + n]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 300
    everything = J.interval_join(lf, rf, [], F.col("t0"), F.col("t1"), "ts")
    assert everything.count() == sum(s <= t <= s + n for _, _, s, n in left for _, _, t in right)
    assert J.interval_join(lf.limit(0), rf, ["k"], F.col("t0"), F.col("t1"), "ts").count() == 0


def test_copies_of_a_long_interval_are_two(spark):
    lf = spark.sql("SELECT 1 AS k, timestamp'2000-01-01' AS a, timestamp'2010-01-01' AS b UNION ALL SELECT 1, timestamp'2001-01-01', timestamp'2001-01-01 00:01:00'")
    rf = spark.range(1000).select(F.lit(1).alias("k"), F.timestamp_seconds(F.lit(946684800) + F.col("id") * 86400 * 5).alias("ts"))
    out = J.interval_join(lf, rf, ["k"], F.col("a"), F.col("b"), "ts")
    rows = []

    def walk(plan):
        if plan.nodeName().startswith("Generate"):
            rows.append(plan.metrics().get("numOutputRows").get().value())
        kids = plan.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        executed = out._jdf.queryExecution().executedPlan()
        n = executed.executeCollect()
        walk(executed)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(n) == 731 and sorted(rows)[0] <= 4 and max(rows) <= 2000


def brute_alias(text, registry):
    hits = [(-len(a), a.lower(), label) for a, label in registry if a and text and a.lower() in text.lower()]
    return min(hits)[2] if hits else None


def test_longest_alias_of_a_table(spark, monkeypatch):
    random.seed(9)
    word = lambda: "".join(random.choices("abcé", k=random.randint(1, 4)))
    registry = [(" ".join(word() for _ in range(random.randint(1, 3))).upper() if i % 3 else word(), f"L{i}") for i in range(150)] + [("", "none"), (None, "null"), ("zzz", "a"), ("zzz", "b")]
    texts = [(i, " ".join(word() for _ in range(random.randint(0, 12)))) for i in range(200)] + [(900, None), (901, ""), (902, "x zzz"), (902, "x zzz"), (903, "q" * 50 + " " + "longest of all " * 30)]
    registry += [("all longest", "over"), ("qqqq", "Q")]
    tf = spark.createDataFrame(texts, "id long, t string")
    rf = spark.createDataFrame(registry, "alias string, label string")
    want = sorted(str((i, t, brute_alias(t, registry))) for i, t in texts)
    for stretch in (2048, 7):
        monkeypatch.setattr(J, "_STRETCH", stretch)
        assert sorted(str((r.id, r.t, r.match)) for r in J.longest_alias_match(tf, "t", "id", rf).collect()) == want
    assert all(r.match is None for r in J.longest_alias_match(tf, "t", "id", rf.limit(0)).collect())


def test_a_hundred_thousand_aliases(spark):
    registry = spark.range(100_000).select(F.concat(F.lit("stadium "), F.col("id")).alias("alias"), F.col("id").cast("string").alias("label"))
    texts = spark.range(0, 100_000, 7).select("id", F.concat(F.lit("the old Stadium "), F.col("id"), F.lit(" of town")).alias("t"))
    out = J.longest_alias_match(texts, "t", "id", registry)
    assert out.where(F.col("match") == F.col("id").cast("string")).count() == texts.count()
