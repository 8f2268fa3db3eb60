"""Exact cases of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import scalar as X


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("accuracy", ["32", "80%", "80"])
def test_accurate_count_reads_counts_and_percentages(spark, accuracy):
    assert one(spark, X.accurate_count(F.lit(40), F.lit(accuracy)))[0] == 32


@pytest.mark.parametrize(
    "text,plain,zero",
    [("7.2", 7.2, 7.2), (" 5 ", 5.0, 5.0), ("80%", None, 80.0), ("", None, 0.0), (None, None, 0.0), ("1d", None, 0.0), ("x", None, 0.0)],
)
def test_numbers(spark, text, plain, zero):
    c = F.lit(text).cast("string")
    assert one(spark, X.to_number(c), X.to_number0(c)) == (plain, zero)


def test_slug_folds_accents(spark):
    row = one(spark, X.slug(F.lit("México  City")), X.slug(F.lit("--")), X.normalise_text(F.lit("Ñandú (Śląsk)")))
    assert row == ("mexico-city", "unknown", "nandu slask")


def test_clip_keeps_null(spark):
    assert one(spark, X.clip(F.lit(None).cast("double"), 0.0, 1.0), X.clip(F.lit(7.0), 0.0, 1.0)) == (None, 1.0)


def test_finite_or_zero(spark):
    row = one(spark, *[X.finite_or_zero(F.lit(v)).alias(f"c{i}") for i, v in enumerate((math.nan, math.inf, 2.5))])
    assert row == (0.0, 0.0, 2.5)


def test_bucket_sides(spark):
    edges, labels = [0.0, 1.0, 2.0], ["a", "b"]
    row = one(
        spark,
        X.bucketise(F.lit(1.0), edges, labels),
        X.bucketise(F.lit(1.0), edges, labels, right=False),
        X.bucketise(F.lit(0.0), edges, labels),
        X.bucketise(F.lit(0.0), edges, labels, include_lowest=True),
    )
    assert row == ("a", "b", None, "a")


def test_stats_map_keeps_the_last_entry(spark):
    arr = F.array(*[F.struct(F.lit(k).alias("type"), F.lit(v).alias("value")) for k, v in (("Fouls", "3"), ("fouls", "4"), ("Ball Possession", "55%"))])
    assert one(spark, X.stats_map(arr))[0] == {"fouls": 4.0, "ball possession": 55.0}


def test_null_aware_sum(spark):
    n = F.lit(None).cast("double")
    assert one(spark, X.null_aware_sum(n, n), X.null_aware_sum(n, F.lit(2.0))) == (None, 2.0)
